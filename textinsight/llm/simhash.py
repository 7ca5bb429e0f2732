"""Near duplicates by SimHash and multi-index hashing."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textinsight.llm.common import ascii_lower, blank_words, materialize
from textinsight.llm.components import connected_components

WORDS = 4
DISTANCE = 4
SEGMENTS = 3
# Table buckets above this are linked through shared middle points instead of pairs.
BUCKET = 128
_CHUNK = 1 << 16  # hashes whose bits are counted at once

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def bit_majority(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run of 64-bit hashes: the bits that more than half of them have. An empty run gives zero."""
    counts = np.zeros((len(starts), 64), np.int64)
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    base = int(starts[0]) if len(starts) else 0
    for at in range(0, len(owner), _CHUNK):
        own = owner[at : at + _CHUNK]
        bits = np.unpackbits(
            hashes[base + at : base + at + len(own)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
            bitorder="little",
        )
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    over = counts * 2 > (ends - starts)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().astype(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        bounds = np.asarray(lists.offsets)
        fp = bit_majority(np.asarray(lists.values), bounds[:-1], bounds[1:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id, fp``: one 64-bit SimHash per row over hashed word shingles, repeats included.

    A text of fewer words gives one shingle, a text of none (or null) the fingerprint zero.
    """
    split = docs.select(F.col(id_col).alias("id"), blank_words(ascii_lower(F.col(text_col))).alias("w"))
    last = F.greatest(F.lit(1), F.size("w") - words + 1)
    hashed = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, words))))
    rows = split.select("id", F.when(F.size("w") > 0, hashed).otherwise(F.array().cast("array<bigint>")).alias("h"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"id {kind}, fp bigint")


def _balls(bits: list[int], radius: int) -> list[int]:
    """Masks of up to ``radius`` of the given bits, as signed 64-bit numbers."""
    return [_signed(sum(1 << b for b in some)) for r in range(radius + 1) for some in combinations(bits, r)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _longs(values: list[int]) -> F.Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def near_links(
    nodes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET,
) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints, with the connections of all pairs at ``distance`` or less.

    Multi-index hashing: of two such fingerprints at least one of the segments differs in no more
    than ``distance // segments`` bits. Every fingerprint enumerates that ball around each of its
    segments, fetches the fingerprints filed under each value, and the whole distances are checked.

    Fingerprints in a bucket of more than ``bucket`` do not probe. Two of them at distance d have
    a common point within ``distance / 2`` of both, and all that share such a point are within
    ``distance`` of each other. So each lists the points of that ball, and those that share one are
    linked in a star instead of in pairs. A probe can thus meet a full bucket only from one of the
    few values around it, and the pairs looked at stay in proportion to the fingerprints.

    The number of segments trades probes against candidates: three suit up to about a hundred
    million fingerprints, two beyond that. The links connect the same documents in any case.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    spans = [list(range(cuts[i], cuts[i + 1])) for i in range(segments)]
    keeps = [_signed(sum(1 << b for b in span)) for span in spans]
    keys = F.array(*[
        F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(keep).cast("bigint")).alias("v"))
        for s, keep in enumerate(keeps)
    ])
    filed = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.s", "k.v")
    full = filed.groupBy("s", "v").count().filter(F.col("count") > bucket).select("s", "v")
    crowded = materialize(filed.join(full, ["s", "v"], "left_semi").select("fp").distinct().withColumn("full", F.lit(True)))
    nodes = materialize(nodes.select("fp").join(crowded, "fp", "left").select("fp", F.coalesce("full", F.lit(False)).alias("full")))
    filed = nodes.select("full", "fp", F.explode(keys).alias("k")).select("full", "fp", "k.s", "k.v")
    balls = F.array(*[_longs(_balls(span, distance // segments)) for span in spans])
    probes = (
        nodes.filter("not full").select(F.col("fp").alias("p"), F.explode(keys).alias("k"))
        .select("p", "k.s", "k.v", F.explode(balls[F.col("k.s")]).alias("m"))
        .select("p", "s", F.col("v").bitwiseXOR(F.col("m")).alias("v"))
    )
    apart = F.bit_count(F.col("p").bitwiseXOR(F.col("fp")))
    # Spark sizes both sides like the nodes before the explodes and would broadcast 67 probes a node.
    pairs = (
        probes.alias("x").join(filed.alias("y").hint("merge"), (F.col("x.s") == F.col("y.s")) & (F.col("x.v") == F.col("y.v"))
                               & (F.col("full") | (F.col("p") < F.col("fp"))) & (apart <= distance) & (apart > 0))
        .select(F.col("p").alias("a"), F.col("fp").alias("b"))
    )
    points = crowded.select("fp", F.explode(_ball_points(distance // 2)).alias("m")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    # A point has at most as many fingerprints around it as its ball has points.
    stars = points.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("point")).alias("b"))
    return pairs.union(stars.filter("a <> b")).distinct()


def _ball_points(radius: int) -> F.Column:
    """All masks of up to ``radius`` bits, built by Spark from the 64 single ones."""
    ones = _longs(_balls(list(range(64)), 1))
    points = ones
    for _ in range(radius - 1):
        points = F.array_distinct(F.flatten(F.transform(points, lambda p: F.transform(ones, lambda q: p.bitwiseXOR(q)))))
    return points


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE,
    segments: int = SEGMENTS, bucket: int = BUCKET,
) -> DataFrame:
    """``id, fp, component_id`` per row: the smallest id reachable over links of close fingerprints.

    Rows of one fingerprint are one node, so exact copies make no pairs. Null and blank texts have
    the fingerprint zero and link like any other. A null id is never a component id unless all ids
    of the component are null. Repeated rows come out repeated; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words))
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = materialize(connected_components(near_links(nodes, distance, segments, bucket)))
    merged = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    least = merged.groupBy("root").agg(F.min("first").alias("component_id"))
    names = merged.join(least, "root").select("fp", "component_id")
    return rows.join(names, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
