"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textinsight.llm.common import BLANK, materialize

BLOCK_BYTES = 1024
_NONE = -1  # stands beside the last name of an odd sequence


def locators(block: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes by which a block finds its name."""
    return F.xxhash64(block), F.xxhash64(F.lit("name"), block)


def _blocks(text: Column, size: int) -> Column:
    raw = text.cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.length(raw) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _named(distinct: DataFrame) -> DataFrame:
    """Rows that are sorted where they are, numbered, and kept, so that a name never changes."""
    return materialize(
        distinct.sortWithinPartitions(*distinct.columns).withColumn("name", F.monotonically_increasing_id())
    )


def block_names(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
    locate: Callable[[Column], tuple[Column, Column]] = locators,
) -> DataFrame:
    """``row, id, sha256, level, name``: two rows have equal (level, name) if and only if their texts are equal.

    Texts are compared after each run of ASCII white space became one space; null is the empty
    text. Fixed-size blocks of the UTF-8 bytes are grouped by content, sorted and numbered. Then
    adjacent names are paired and the distinct pairs named, until one name is left of each
    document; ``level`` is the number of rounds it took.

    Block contents are shuffled once, to be named. Documents find the names of their blocks by
    two 64-bit hashes. Should two different blocks agree in both, the documents look up by content
    instead, so that no result depends on a hash. Equal blocks are merged before each shuffle;
    the lookups are joins whose hot keys adaptive execution splits.

    Repeated rows, also with one id, are rows of their own. An empty table gives no rows.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANK, " ")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    blocks = texts.select(F.explode_outer(_blocks(F.col("text"), block_bytes)).alias("block"))
    first, second = locate(F.col("block"))
    names = materialize(
        blocks.distinct().sortWithinPartitions("block")
        .select(first.alias("a"), second.alias("b"), F.monotonically_increasing_id().alias("name"))
    )
    clash = names.groupBy("a", "b").count().filter("count > 1").isEmpty() is False
    found = F.transform(_blocks(F.col("text"), block_bytes), lambda x: F.struct(*_keys(x, clash, locate)))
    base = materialize(texts.select(
        F.monotonically_increasing_id().alias("row"), "id", F.sha2("text", 256).alias("sha256"), found.alias("keys"),
    ))
    pieces = base.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    pieces = pieces.select("row", "n", "pos", "key.a", "key.b")
    if clash:
        names = _named(blocks.select(F.col("block").alias("a"), F.lit(0).alias("b")).distinct())
    ends, level = [], 0
    while True:
        placed = materialize(pieces.join(names, ["a", "b"]).select("row", "n", "pos", "name"))
        ends.append(placed.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = placed.filter("n > 1")
        if rest.isEmpty():
            break
        level += 1
        even = F.col("pos") % 2 == 0
        pieces = materialize(
            rest.groupBy("row", F.floor((F.col("n") + 1) / 2).cast("int").alias("n"),
                         F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"),
                 F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(_NONE)).alias("b"))
        )
        names = _named(pieces.select("a", "b").distinct())
    identity = ends[0]
    for part in ends[1:]:
        identity = identity.unionByName(part)
    return base.select("row", "id", "sha256").join(identity, "row")


def _keys(block: Column, clash: bool, locate) -> list[Column]:
    a, b = (block, F.lit(0)) if clash else locate(block)
    return [a.alias("a"), b.alias("b")]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, text_sha256``; see ``block_names``.

    Of equal texts the row with the smallest id stays, a null id last; of rows that also agree in
    the id exactly one is kept.
    """
    named = materialize(block_names(docs, id_col, text_col, **options))
    order = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("row").alias("row"))
    groups = named.groupBy("level", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    return named.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha256").alias("text_sha256"),
    )
