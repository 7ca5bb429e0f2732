"""Language identification by prediction by partial matching."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textinsight.llm.bytegrams import ORDER, PAD, Lookup, contexts, count_grams, counted, strings
from textinsight.llm.common import materialize
from textinsight.session import small_side

# The classifier is fitted on at most so many labelled rows of each language, whole texts.
ROWS_PER_LANGUAGE = 1000
UNKNOWN = "und"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _padded(text: Column) -> Column:
    return F.concat(F.lit(PAD), F.lower(F.coalesce(text, F.lit(""))))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            rows = pc.equal(batch.column(0), lang)
            found = count_grams(*strings(batch.column(1).filter(rows)))
            if found:
                keys, counts = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def sample_rows(labelled: DataFrame, lang_col: str, id_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows of each language, and never more, drawn by a hash of the id."""
    sizes = small_side(materialize(labelled.groupBy(lang_col).agg(F.count("*").alias("_n"))))
    hashed = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / (1 << 30)
    drawn = (
        labelled.withColumn("_u", hashed).join(sizes, lang_col)
        .filter(F.col("_u") * F.col("_n") < rows)
    )
    place = F.row_number().over(Window.partitionBy(lang_col).orderBy("_u", F.xxhash64("text")))
    return drawn.withColumn("_place", place).filter(F.col("_place") <= rows)


class PartialMatching:
    """Frozen statistics of all languages: code lengths in bits of a byte after its context.

    In a context of a language seen n times with q different bytes, a byte seen c times has
    probability c / (n + q); the remaining q / (n + q) is the escape to the context one byte
    shorter, and below the empty context all 256 bytes are as likely. A context never seen is left
    for the shorter one at no cost. ``grams[d]`` finds a byte with d bytes of context that any
    language has seen, and ``bits[d]`` has its whole code length in each; ``escapes[d]`` has what
    each language pays in a context for a byte no language has seen there.
    """

    def __init__(self, languages: list[str], which: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        self.languages = languages
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        lower = None
        for d in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (d + 1)) - 1)
            own = [counted([(keys[which == i] & mask, counts[which == i])]) if (which == i).any() else None for i in range(len(languages))]
            grams = np.unique(np.concatenate([x[0] for x in own if x]))
            seen = np.unique(grams >> np.uint64(8))
            bits = np.empty((len(grams), len(languages)))
            escapes = np.zeros((len(seen), len(languages)))
            parent = np.searchsorted(seen, grams >> np.uint64(8))
            below = lower.cost(grams & (mask >> np.uint64(8))) if lower else np.full((len(grams), 1), 8.0)
            for i, x in enumerate(own):
                if x is None:
                    bits[:, i] = below[:, min(i, below.shape[1] - 1)]
                    continue
                at = np.searchsorted(seen, x[0] >> np.uint64(8))
                n, q = np.bincount(at, x[1], len(seen)), np.bincount(at, minlength=len(seen))
                escapes[:, i] = np.where(q > 0, np.log2(np.maximum(n + q, 1) / np.maximum(q, 1)), 0)
                bits[:, i] = escapes[parent, i] + below[:, min(i, below.shape[1] - 1)]
                bits[np.searchsorted(grams, x[0]), i] = np.log2((n + q)[at] / x[1])
            self.grams.append(Lookup(grams))
            self.contexts.append(Lookup(seen))
            self.bits.append(bits.astype(np.float32))
            self.escapes.append(escapes.astype(np.float32))
            lower = self

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language; ``keys`` hold the context and the byte."""
        top = len(self.grams) - 1
        row = self.grams[top].find(keys)
        out = self.bits[top][row]
        rest = np.flatnonzero(row < 0)
        if len(rest):
            out[rest] = 0
            for d in range(top, -1, -1):
                key = keys[rest] & np.uint64((1 << 8 * (d + 1)) - 1)
                row = self.grams[d].find(key)
                out[rest[row >= 0]] += self.bits[d][row[row >= 0]]
                rest, key = rest[row < 0], key[row < 0]
                if not len(rest):
                    return out
                context = self.contexts[d].find(key >> np.uint64(8))
                out[rest[context >= 0]] += self.escapes[d][context[context >= 0]]
            out[rest] += 8
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_language: int = ROWS_PER_LANGUAGE) -> PartialMatching | None:
    """Fit on rows with text and language; ``None`` without any. The statistics are those of at most
    ``rows_per_language`` texts a language, which bounds what the driver gathers and sends out."""
    usable = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = usable.filter("text is not null and lang is not null")
    drawn = sample_rows(usable, "lang", "id", rows_per_language).select("lang", _padded(F.col("text")).alias("text"))
    grams = drawn.mapInArrow(_count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.toArrow()
    if not len(table):
        return None
    names = table.column("lang").to_pandas()
    languages = sorted(names.unique())
    which = names.map({x: i for i, x in enumerate(languages)}).to_numpy()
    return PartialMatching(languages, which, table.column("gram").to_numpy().astype(np.uint64), table.column("n").to_numpy())


def predict_language(docs: DataFrame, model: PartialMatching | None, text_col: str = "text",
                     keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default), ``lang_pred`` and ``score`` (0 to 1): the language that
    codes the whole text shortest.

    The score is the language's share of the probability of the text, all languages being as likely
    before. A null text or one without a letter, and every text without a model, is ``und`` with
    score 0. Ties go to the name that sorts first. Input columns named ``lang_pred`` or ``score``
    are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    names = list(docs.columns if keep is None else keep)
    if model is None:
        return docs.select(*[F.col(f"`{n}`") for n in names], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"),
                       F.when(letters, _padded(F.col(text_col))).otherwise("").alias("padded"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        labels = pa.array([*fitted.languages, UNKNOWN])
        for batch in batches:
            data, offsets = strings(batch.column(1))
            bits = np.zeros((batch.num_rows, len(fitted.languages)))
            for keys, owner, starts in contexts(data, offsets):
                bits[owner] += np.add.reduceat(fitted.cost(keys), starts, axis=0, dtype=np.float64)
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1)
            none = offsets[1:] == offsets[:-1]
            best[none], share[none] = len(fitted.languages), 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), labels.take(pa.array(best)), pa.array(share)], names=["row", "lang_pred", "score"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(predict, f"row {kind}, lang_pred string, score double").select("row.*", "lang_pred", "score")
