"""TF-IDF in long form, over a corpus and inside groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from ..functions.text import bind, exploded, term_counts, terms, unigrams_and_bigrams
from ..session import BROADCAST_BYTES, BROADCAST_ROWS, cut_lineage, discard, is_small, lookup_join, written

# A term is hot when it holds at least this share of all (document, term) pairs,
# so there are at most 1 / share hot terms whatever the corpus.
HOT_SHARE = 0.001
HOT_SALTS = 64
COUNTS = ArrayType(StructType().add("term", "string").add("tf", "long"))
# Answers counted at a time inside a task.
SLICE_ROWS = 2000


def default_stop_words(spark: SparkSession, language: str = "english") -> list[str]:
    """Spark's own stop word list of a language."""
    from pyspark.ml.feature import StopWordsRemover

    spark.sparkContext  # the list lives in the JVM of a running session
    return StopWordsRemover.loadDefaultStopWords(language)


def resolve_stop_words(spark: SparkSession, stop_words: Sequence[str] | None) -> list[str]:
    if stop_words is not None:
        return list(stop_words)
    return default_stop_words(spark)


def term_frequencies(
    df: DataFrame, key_cols: Sequence[str], text_col: str, stop_words: Sequence[str] = (), with_bigrams: bool = False
) -> DataFrame:
    """``(keys..., term, tf)``: counted inside each row, without a shuffle."""
    tokens = terms(F.col(text_col), stop_words)
    if with_bigrams:
        tokens = unigrams_and_bigrams(tokens)
    counted = exploded(df, key_cols, term_counts(tokens), "_count")
    return counted.select(*key_cols, "_count.term", "_count.tf")


def doc_frequency(frequencies: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Documents per term (``df``) and total count (``n``), combined map-side."""
    return frequencies.groupBy(*group_cols, "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")
    )


def idf(n_docs: Column, df: Column) -> Column:
    """Smoothed inverse document frequency: ln((1 + n) / (1 + df)) + 1."""
    return F.log((1 + n_docs) / (1 + df)) + 1


def hot_terms(dictionary: DataFrame) -> DataFrame:
    """Terms that hold ``HOT_SHARE`` of all pairs or more: at most 1 / HOT_SHARE rows."""
    total = dictionary.agg(F.sum("df").alias("pairs"))
    return dictionary.filter(F.col("df") >= HOT_SHARE * total.scalar()).select("term")


def term_join(
    pairs: DataFrame, table: DataFrame, hot: DataFrame, spread_by: Column, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Inner join of ``pairs`` with a ``table`` that has one row per ``term``.

    A table of at most ``max_rows`` rows is broadcast. A larger one is joined by
    shuffle, with the pairs of each hot term spread over ``HOT_SALTS`` keys; only the
    hot rows of the table are repeated.
    """
    if is_small(table, max_rows):
        return pairs.join(F.broadcast(table), "term")
    flagged = F.broadcast(hot.withColumn("_hot", F.lit(True)))  # bounded by hot_terms
    left = pairs.join(flagged, "term", "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(HOT_SALTS))).otherwise(F.lit(0))
    )
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(flagged, "term", "left").withColumn("_salt", F.explode(salts.cast("array<bigint>")))
    return left.drop("_hot").join(right.drop("_hot"), ["term", "_salt"]).drop("_salt")


def term_dictionary(counts: DataFrame, n_docs: Column, numbered: bool = True) -> DataFrame:
    """``(term, term_id, df, idf)`` of ``counts(id, counts)``; ids are dense from 0, frequent terms first.

    Every partition of the counted terms numbers its own; the numbers are shifted by the sizes of the
    partitions before, one row each. ``numbered=False`` leaves the ids null.
    """
    rows = exploded(counts, [], F.col("counts.term"), "term")
    totals = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a document has a term once
    ordered = totals.sort(F.desc("df")) if numbered else totals
    placed = written(ordered.withColumn("_at", F.monotonically_increasing_id()))
    weight = idf(n_docs, F.col("df")).alias("idf")
    if not numbered:
        return placed.select("term", F.lit(None).cast("bigint").alias("term_id"), "df", weight)
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(cut_lineage(starts)), "_part").select(
        "term", (F.col("_start") + inside).alias("term_id"), "df", weight)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _lists(size: int, row: np.ndarray, values: pa.Array) -> pa.ListArray:
    """``values`` as ``size`` lists, ``row`` ascending."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=size))], pa.int32()), values)


def _document_counts(df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str]) -> DataFrame:
    """``(id, counts)``: the distinct terms of each answer and how often each occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            words = part.column(1).flatten().dictionary_encode()
            owner = pc.list_parent_indices(part.column(1)).to_numpy().astype(np.int64)
            size = max(len(words.dictionary), 1)
            at, tf = np.unique(owner * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            entries = pa.StructArray.from_arrays([words.dictionary.take(pa.array(at % size)), pa.array(tf, pa.int64())], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(len(part), at // size, entries)], names=[id_col, "counts"])

    tokens = df.select(id_col, terms(F.col(text_col), stop_words).alias("_tokens"))
    return tokens.mapInArrow(count, StructType([tokens.schema[id_col]]).add("counts", COUNTS))


def _least_common(dictionary: DataFrame, max_rows: int) -> int | None:
    """The number of documents from which on all terms together may be broadcast; None if that holds for no term."""
    step = F.floor(4 * F.log2("df"))  # some hundred steps at most
    size = F.sum(F.octet_length("term") + 24)
    steps = dictionary.groupBy(step.alias("step")).agg(F.min("df").alias("df"), F.count(F.lit(1)).alias("n"), size.alias("size"))
    least, rows, volume = None, 0, 0
    for row in sorted(steps.collect(), key=lambda row: -row["df"]):
        rows, volume = rows + row["n"], volume + row["size"]
        if rows > max_rows or volume > BROADCAST_BYTES:
            break
        least = row["df"]
    return least


def unit_weights() -> Column:
    """The weights of norm 1 of rows that hold ``raw`` ones and ``square``, the sum of their squares."""
    return bind(F.sqrt("square"), lambda norm: F.transform("raw", lambda w: w / norm))


def _looked_up(
    counts: DataFrame, dictionary: DataFrame, id_col: str, with_terms: bool, keep: Sequence[str] = (), whole: bool = True,
) -> tuple[DataFrame, Callable[[], None]]:
    """``(id, terms, tfs, term_ids, raw, square)`` with the dictionary at hand in every task, and what lets go of it.

    ``raw`` are weights before the norm, of which there are few different ones; ``square`` is the sum of their
    squares. Without the ``whole`` dictionary ``rest`` holds the counts of the terms that are not in it.
    """
    known = dictionary.select("term", "term_id", "idf").toArrow()  # bounded by the caller's check
    shared = counts.sparkSession.sparkContext.broadcast((
        known.column("term").combine_chunks().cast(pa.string()), known.column("term_id").fill_null(0).to_numpy(),
        known.column("idf").to_numpy()))
    rows = counts.select(id_col, *keep, F.col("counts.term").alias("terms"), F.col("counts.tf").alias("tfs"))
    place = len(keep) + 1

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers, factors = shared.value
        for batch in batches:
            size, lists = len(batch), batch.column(place)
            word, tf = (batch.column(i).flatten() for i in (place, place + 1))
            row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            found = pc.index_in(word.cast(words.type), value_set=words)
            hit = found.is_valid().to_numpy(zero_copy_only=False)
            at = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            own, kept = row[hit], word.filter(pa.array(hit))
            times = tf.to_numpy(zero_copy_only=False)
            weight = times[hit] * factors[at]
            square = np.bincount(own, weight * weight, size)
            values = [pa.array(times[hit], pa.int64()), pa.array(numbers[at].astype(np.int64)), pa.array(weight, pa.float64())]
            if with_terms:
                values.insert(0, kept)
            columns = [*batch.columns[:place], *(_lists(size, own, x) for x in values), pa.array(square, pa.float64())]
            if not whole:
                rest = pa.StructArray.from_arrays([word.filter(pa.array(~hit)), pa.array(times[~hit], pa.int64())], names=["term", "tf"])
                columns.append(_lists(size, row[~hit], rest))
            yield pa.RecordBatch.from_arrays(columns, names=shape.fieldNames())

    shape = StructType([rows.schema[c] for c in (id_col, *keep)])
    if with_terms:
        shape = shape.add("terms", ArrayType(StringType()))
    shape = shape.add("tfs", ArrayType(LongType())).add("term_ids", ArrayType(LongType())).add("raw", ArrayType(DoubleType())).add("square", "double")
    if not whole:
        shape = shape.add("rest", COUNTS)
    return rows.mapInArrow(look_up, shape), shared.destroy


def _joined(
    counts: DataFrame, dictionary: DataFrame, id_col: str, max_rows: int, with_terms: bool,
) -> tuple[DataFrame, Callable[[], None]]:
    """The same for any dictionary: its most common terms, most of all pairs, are looked up, the others join it.

    The rows that come back from the join are numbers of rare terms; they meet their answer by the number of its row.
    """
    least = _least_common(dictionary, max_rows)
    common = F.lit(False) if least is None else F.col("df") >= least
    numbered = counts.withColumn("_at", F.monotonically_increasing_id())
    rows, let_go = _looked_up(numbered, dictionary.filter(common), id_col, with_terms, ["_at"], whole=False)
    placed = written(rows)
    let_go()
    discard(counts)
    totals = dictionary.agg(F.sum("df").alias("pairs"))
    others = dictionary.filter(~common)
    hot = others.filter(F.col("df") >= HOT_SHARE * totals.scalar()).select("term")
    rows = exploded(placed, ["_at"], F.col("rest"), "_count").select("_at", "_count.term", "_count.tf")
    met = term_join(rows, others.select("term", "term_id", "idf"), hot, F.col("_at"), max_rows)
    names = [*(["term"] if with_terms else []), "term_id", "tf"]
    entry = F.struct(*names, (F.col("tf") * F.col("idf")).alias("weight"))
    entries = met.groupBy("_at").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))

    def both(name: str, inner: str) -> Column:
        return F.when(F.col("_entries").isNull(), F.col(name)).otherwise(F.concat(name, F.col(f"_entries.{inner}")))

    squares = F.aggregate(F.coalesce(F.col("_entries.weight"), F.array().cast("array<double>")), F.col("square"), lambda total, w: total + w * w)
    return placed.drop("rest").join(entries, "_at", "left").select(
        id_col, *([both("terms", "term").alias("terms")] if with_terms else []), both("tfs", "tf").alias("tfs"),
        both("term_ids", "term_id").alias("term_ids"), both("raw", "weight").alias("raw"), squares.alias("square")), lambda: discard(placed)


def raw_vectors(
    df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] | None, max_rows: int = BROADCAST_ROWS,
    with_terms: bool = False, numbered: bool = True,
) -> tuple[DataFrame, DataFrame, list[Callable[[], None]]]:
    """``tfidf_vectors`` with ``raw`` and ``square`` in place of the weights, and what deletes all that they are read from.

    Different raw weights are few, so rows that are written with them take a fraction of the room.
    """
    stop_words = resolve_stop_words(df.sparkSession, stop_words)
    counts = written(_document_counts(df, id_col, text_col, stop_words))  # numbers the terms, then is weighted
    dictionary = term_dictionary(counts, df.agg(F.count(F.lit(1)).alias("n")).scalar(), numbered)
    if is_small(dictionary, max_rows):
        rows, let_go = _looked_up(counts, dictionary, id_col, with_terms)
    else:
        rows, let_go = _joined(counts, dictionary, id_col, max_rows, with_terms)
    return rows, dictionary, [let_go, lambda: discard(counts), lambda: discard(dictionary)]


def tfidf_vectors(
    df: DataFrame, id_col: str = "response_id", text_col: str = "response", stop_words: Sequence[str] | None = None,
    max_rows: int = BROADCAST_ROWS, with_terms: bool = False, numbered: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """One sparse row per answer, ``(id, tfs, term_ids, weights)``, and the ``(term, term_id, df, idf)`` they refer to.

    Answers are counted once. Weights are worked out and brought to norm 1 in the row. A dictionary that may
    be broadcast is looked up where the answer is read, without any shuffle; beyond that only its rare terms
    are joined. Ids ascend as the documents of a term get fewer. An answer without terms, or a null one, has
    empty arrays. ``id`` is unique. ``with_terms`` adds the words themselves, for which the term ids
    need not be ``numbered``.
    """
    rows, dictionary, _ = raw_vectors(df, id_col, text_col, stop_words, max_rows, with_terms, numbered)
    return rows.select(id_col, *(["terms"] if with_terms else []), "tfs", "term_ids", unit_weights().alias("weights")), dictionary


def tfidf(
    df: DataFrame, id_col: str = "response_id", text_col: str = "response", stop_words: Sequence[str] | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Unigram TF-IDF over all answers: ``(id, term, tf, weight)``, rows of norm 1.

    The long form of ``tfidf_vectors``. Answers without terms have no rows.
    """
    rows, _ = tfidf_vectors(df, id_col, text_col, stop_words, max_rows, with_terms=True, numbered=False)
    entries = F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"), F.col("weights").alias("weight"))
    return exploded(rows, [id_col], entries, "_entry").select(id_col, "_entry.term", "_entry.tf", "_entry.weight")


def limit_vocabulary(totals: DataFrame, group_cols: Sequence[str], max_features: int, count: str = "n") -> DataFrame:
    """The ``max_features`` most frequent terms of each group, ties in term order."""
    order = Window.partitionBy(*group_cols).orderBy(F.desc(count), F.asc("term"))
    return totals.withColumn("_rank", F.row_number().over(order)).filter(
        F.col("_rank") <= max_features
    ).drop("_rank")


def group_candidates(
    df: DataFrame, group: str, id_col: str, text_col: str, stop_words: Sequence[str], max_features: int = 100,
) -> DataFrame:
    """``(group, id, counts)``: per answer, the terms that can enter the vocabulary.

    The ``max_features`` most frequent words of each group are listed, ties in word order. The
    first word of a kept bigram is one of them: it is at least as frequent as its bigram, and where
    it is equally frequent it sorts before it. So only listed words and the bigrams that begin with
    one leave their row. A null group has no candidates.

    What is left is a part of the text and is read several times, so it is written out once.
    """
    tokens = terms(F.col(text_col), stop_words)
    totals = exploded(df, [group], tokens, "term").groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))
    listed = limit_vocabulary(totals, [group], max_features)
    lists = listed.groupBy(group).agg(F.array_join(F.collect_list("term"), " ").alias("_words"))

    joined = lookup_join(df.select(group, id_col, text_col), lists, [group], id_col).select(
        group, id_col, "_words", tokens.alias("_tokens"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            owner = pc.list_parent_indices(part.column(3)).to_numpy().astype(np.int64)
            words = part.column(3).flatten().dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            size = max(len(words.dictionary), 1)
            # one list per group: its words as numbers of the slice's words
            of_group = part.column(2).dictionary_encode()
            listed = pc.split_pattern(of_group.dictionary, " ")
            known = pc.index_in(listed.flatten(), value_set=words.dictionary)
            there = known.is_valid().to_numpy(zero_copy_only=False)
            keys = pc.list_parent_indices(listed).to_numpy().astype(np.int64)[there] * size
            keys = np.sort(keys + known.drop_null().to_numpy(zero_copy_only=False))
            wanted = of_group.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner] * size + code
            found = np.searchsorted(keys, wanted)
            hit = np.flatnonzero(np.r_[keys, -1][found] == wanted)
            pair = hit[np.r_[owner, -1][hit + 1] == owner[hit]]
            # a word alone has no follower, number 0
            first = np.r_[hit, pair]
            follower = np.r_[np.zeros(len(hit), np.int64), code[np.minimum(pair + 1, len(code) - 1)] + 1]
            at, tf = np.unique((owner[first] * size + code[first]) * (size + 1) + follower, return_counts=True)
            row, head, tail = at // (size + 1) // size, at // (size + 1) % size, at % (size + 1)
            alone = words.dictionary.take(pa.array(head))
            after = words.dictionary.take(pa.array(tail - 1, mask=tail == 0))
            term = pc.coalesce(pc.binary_join_element_wise(alone, after, " "), alone)
            entries = pa.StructArray.from_arrays([term, pa.array(tf, pa.int64())], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], _lists(len(part), row, entries)], names=[group, id_col, "counts"])

    shape = StructType([joined.schema[group], joined.schema[id_col]]).add("counts", COUNTS)
    return cut_lineage(joined.mapInArrow(count, shape).filter(F.size("counts") > 0))


def candidate_vocabulary(candidates: DataFrame, group: str, max_features: int = 100) -> DataFrame:
    """``(group, term, n, df)``: the most frequent unigrams and bigrams of each group."""
    rows = candidates.select(group, F.explode("counts").alias("_count"))
    totals = doc_frequency(rows.select(group, "_count.term", "_count.tf"), [group])
    return limit_vocabulary(totals, [group], max_features)


def group_vocabulary(
    df: DataFrame, group: str, id_col: str, text_col: str, stop_words: Sequence[str], max_features: int = 100
) -> DataFrame:
    """``(group, term, n, df)`` of the answers themselves."""
    candidates = group_candidates(df, group, id_col, text_col, stop_words, max_features)
    return candidate_vocabulary(candidates, group, max_features)


def tfidf_by_group(
    df: DataFrame,
    group: str = "cluster",
    id_col: str = "response_id",
    text_col: str = "response",
    stop_words: Sequence[str] | None = None,
    max_features: int = 100,
) -> DataFrame:
    """TF-IDF refitted inside each group: ``(group, id, term, tf, weight)``.

    Unigrams and bigrams, document counts per group, vocabulary capped before the
    norm. The capped vocabulary rides along with each row as a small map, so a
    document is weighted and normalised where it was read.
    """
    stop_words = resolve_stop_words(df.sparkSession, stop_words)
    candidates = group_candidates(df, group, id_col, text_col, stop_words, max_features)
    vocabulary = cut_lineage(candidate_vocabulary(candidates, group, max_features))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_docs"))
    maps = vocabulary.join(sizes, group).groupBy(group).agg(
        F.map_from_entries(F.collect_list(F.struct("term", idf(F.col("_docs"), F.col("df"))))).alias("_idf")
    )

    def weighted(count: Column) -> Column:
        weight = count["tf"] * F.try_element_at(F.col("_idf"), count["term"])
        return F.struct(count["term"].alias("term"), count["tf"].alias("tf"), weight.alias("weight"))

    kept = F.filter(F.transform(F.col("counts"), weighted), lambda entry: entry["weight"].isNotNull())
    rows = exploded(lookup_join(candidates, maps, [group], id_col), [group, id_col], bind(kept, _unit_length), "_row")
    return rows.select(group, id_col, "_row.term", "_row.tf", "_row.weight")


def _unit_length(entries: Column) -> Column:
    squares = F.aggregate(entries, F.lit(0.0), lambda total, entry: total + entry["weight"] * entry["weight"])
    return bind(
        F.sqrt(squares),
        lambda norm: F.transform(
            entries,
            lambda entry: F.struct(
                entry["term"].alias("term"), entry["tf"].alias("tf"), (entry["weight"] / norm).alias("weight")
            ),
        ),
    )
