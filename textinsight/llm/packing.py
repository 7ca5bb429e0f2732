"""Documents packed into token sequences of one size by sums of squares."""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textinsight.llm.common import materialize

TOKENS = 2048
END = 0  # the id after each document
# Pieces one task packs at once.
SHARD = 1 << 15
# Words whose ids a worker keeps, and bytes of text it splits at once.
CACHE_WORDS = 1_000_000
PART_BYTES = 1 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- tokens -----------------------------------------------------------------------------------

# One sentence mark after a letter and before white space: the tokenizer splits there in any case.
_MARK = re.compile(rb"[.,;:!?](?:(?<=[a-z].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))(?=[ \t-\r]|\Z)", re.S)
# Lower-case letters that no normalisation changes.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_BLANK = re.compile(rb"[ \t-\r]")


class Encoder:
    """Token ids of UTF-8 texts as little-endian unsigned 32-bit numbers, each different word encoded once.

    That serves tokenizers that lower-case, drop white space, keep runs of letters together and
    mark the end of a word: a text's ids are then those of its words between white space. With any
    other tokenizer, and for texts that may hold a special token, whole texts are encoded.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, part_bytes: int = PART_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.cache_words, self.part_bytes = cache_words, part_bytes
        with open(path, encoding="utf-8") as file:
            self.by_word = _splits_at_blanks(json.load(file))
        self.specials = [t.content[:2].lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.by_word:
            spell = {chr(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c)) for c in range(0xDF, 0x100) if c != 0xF7}
            self.spell = str.maketrans({c: parts[0][0] for c, parts in spell.items()})

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > self.cache_words:
            self.cache.clear()
            new = list(words)
        rest, model = [], self.tokenizer.model
        for word in new:
            if _LETTERS.fullmatch(word):
                tokens = model.tokenize(word.decode().translate(self.spell))
                self.cache[word] = np.array([t.id for t in tokens], "<u4").tobytes()
            else:
                rest.append(word)
        self.cache.update(zip(rest, self._whole(rest)))

    def encode(self, text: bytes) -> bytes:
        lowered = text.lower()  # A-Z only
        if not self.by_word or any(s in lowered for s in self.specials):
            return self._whole([text])[0]
        out, at = [], 0
        while at < len(lowered):
            cut = _BLANK.search(lowered, min(at + self.part_bytes, len(lowered)))
            end = cut.start() if cut else len(lowered)
            words = _MARK.sub(rb" \g<0>", lowered[at:end]).split()
            self._learn(set(words))
            out.append(b"".join(map(self.cache.__getitem__, words)))
            at = end
        return b"".join(out)


def _splits_at_blanks(spec: dict) -> bool:
    """Whether the tokenizer is of the kind whose words can be encoded one by one."""
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = splits[0].get("pattern", {}).get("Regex", "") if splits else ""
    return (
        normal == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        and not splits[1]["add_prefix_space"] and not splits[1].get("use_regex")
        and spec["model"]["end_of_word_suffix"] == "</w>" and not spec["model"].get("continuing_subword_prefix")
    )


def _encoder(path: str) -> Encoder:
    """The encoder of this worker process. This module travels by value, so what outlives a task is kept beside it."""
    kept = sys.modules.setdefault("_textinsight_encoders", ModuleType("_textinsight_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def token_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``) of the pieces of every text.

    A document is its token ids and one ``END``; null is the empty text. It is cut into pieces of
    ``tokens`` ids, of which the last may be shorter. ``tokenizer`` is a path every executor can read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                raw = encoder.encode(text.as_py()) + END.to_bytes(4, "little")
                for number, at in enumerate(range(0, len(raw), 4 * tokens)):
                    part = raw[at : at + 4 * tokens]
                    row.append(i)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long{more}")


# --- packing ----------------------------------------------------------------------------------


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each length, in the given order.

    ``open[g]`` counts the bins with a gap of g. A length s moves one bin from gap g to g - s, which
    changes the sum of the squared counts by 2 (open[g - s] - open[g] + 1), or by 1 - 2 open[g] if it
    fills the bin. Of the gaps that have room the one of the smallest sum is taken, of equal ones the
    smallest gap. A new bin opens where no open bin has room, so that none is spent on the sum alone.
    """
    count = np.zeros(capacity + 1, np.int64)
    held: list[list[int]] = [[] for _ in range(capacity + 1)]  # the open bins of each gap
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, never = 0, np.int64(1) << 62
    for at, size in enumerate(lengths.tolist()):
        after = count[: capacity - size + 1]  # by the gap that is left
        before = count[size:]
        change = np.where(before > 0, 2 * (after - before) + 2, never)
        if before[0]:
            change[0] = 1 - 2 * before[0]
        gap = int(change.argmin()) + size
        if change[gap - size] < never:
            number = held[gap].pop()
            count[gap] -= 1
        else:
            number, gap = opened, capacity
            opened += 1
        bins[at], places[at] = number, capacity - gap
        if gap > size:
            held[gap - size].append(number)
            count[gap - size] += 1
    return bins, places


def _pack(capacity: int):
    def run(key: tuple[pa.Scalar, ...], items: pa.Table) -> pa.Table:
        length, item = items.column("length").to_numpy(), items.column("item").to_numpy()
        order = np.lexsort((item, -length))
        number, place = sum_of_squares(length[order], capacity)
        fill = np.bincount(number, length[order]).astype(np.int64)
        return pa.table({
            "item": item[order], "bin": (key[0].as_py() << 32) + number, "at": place, "fill": fill[number],
        })

    return run


def pack(items: DataFrame, capacity: int = TOKENS, shard: int = SHARD) -> DataFrame:
    """``item, sequence_id, offset``: items of ``items(item, length)`` in as few sequences as they fit.

    Items are dealt at random into shards of about ``shard`` and each shard is packed from the longest
    item down, by sums of squares. The sequences that are not full and could still take the shortest one of
    another shard are the items of the next round, until one shard holds them all or no two of them
    fit together. So no task meets more than about ``shard`` items, however many there are.
    """
    whole = items.filter(F.col("length") >= capacity).select(
        "item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, turn = items.filter(F.col("length") < capacity).select("item", "length"), 0
    placed = moves = None
    while True:
        many = left.count()
        shards = max(1, -(-many // shard))
        turn += 1
        dealt = left.withColumn("_shard", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(shards)))
        numbered = (F.col("bin") + (F.lit(turn).cast("long") * F.lit(1 << 56))).alias("bin")
        new = materialize(dealt.groupBy("_shard").applyInArrow(
            _pack(capacity), "item long, bin long, at long, fill long").select("item", numbered, "at", "fill"))
        step = new.select(F.col("item").alias("_from"), F.col("bin").alias("_to"), F.col("at").alias("_by"))
        if placed is None:
            placed = new.select("item", "bin", "at")
        elif moves is None:  # where a sequence of the first round has gone
            moves = step.select(F.col("_from").alias("bin"), F.col("_to").alias("to"), F.col("_by").alias("by"))
        else:
            moves = materialize(moves.join(step, moves["to"] == step["_from"], "left").select(
                "bin", F.coalesce("_to", "to").alias("to"), (F.col("by") + F.coalesce("_by", F.lit(0))).alias("by")))
        if shards == 1:
            break
        bins = new.groupBy("bin").agg(F.max("fill").alias("length"))
        least = bins.agg(F.min("length")).first()[0]
        open_bins = bins.filter(F.col("length") + F.lit(least) <= capacity).withColumnRenamed("bin", "item")
        rest = materialize(open_bins)
        if rest.count() in (0, 1, many):
            break
        left = rest
    if moves is not None:
        placed = placed.join(moves, "bin", "left").select(
            "item", F.coalesce("to", "bin").alias("bin"), (F.col("at") + F.coalesce("by", F.lit(0))).alias("at"))
    return placed.select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset")).unionByName(whole)


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS,
    shard: int = SHARD, with_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``): every piece and its place.

    The pieces of ``token_pieces``, packed by ``pack`` into sequences of at most ``tokens``; places are
    gapless from 0 in each. Only documents longer than a sequence are cut.

    A null text is one ``END``, and so are empty and blank ones. Rows that repeat an id, or all of a
    row, are documents of their own; a null id stays null. An empty table gives no rows. Other columns
    are not read, whatever their names.
    """
    pieces = materialize(
        token_pieces(docs, tokenizer, id_col, text_col, tokens, with_ids)
        .withColumn("item", F.monotonically_increasing_id()))
    places = pack(pieces.select("item", "length"), tokens, shard)
    more = ["ids"] if with_ids else []
    return pieces.join(places, "item").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *more)


def token_sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, lengths`` of packed documents with ids: the sequences to train on."""
    one = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(one.alias("_parts")).select(
        "sequence_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"),
        F.transform("_parts", lambda p: p["length"]).alias("lengths"))
