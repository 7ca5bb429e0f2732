"""Shards along a Hilbert curve through document metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textinsight.llm.common import global_rank

SHARDS = 40
BITS = 6  # of each dimension
ROW_BYTES = 16  # that a row takes besides its text


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve; each axis is a whole number of ``bits`` bits.

    From the highest bit down, each axis whose bit is set mirrors the lower bits of the first axis;
    an axis whose bit is clear swaps them with the first axis. What is left is a Gray code of the
    index, read one bit of each axis at a time.
    """
    n = len(axes)
    steps = F.array(*[
        F.struct(F.lit(1 << b).cast("bigint").alias("q"), F.lit(i).alias("i"))
        for b in range(bits - 1, 0, -1) for i in range(n)
    ]).cast("array<struct<q:bigint,i:int>>")  # empty for one bit

    def turn(x: Column, step: Column) -> Column:
        low, at = step.q - 1, F.get(x, step.i)
        mirrored = at.bitwiseAND(step.q) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(at).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(mirrored, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
                           .when((j == 0) | (j == step.i), v.bitwiseXOR(swap)).otherwise(v))

    places = F.array(*[
        F.struct(F.lit(1 << b).cast("bigint").alias("q"), F.lit(i).alias("i"))
        for b in range(bits - 1, -1, -1) for i in range(n)
    ])
    zero = F.lit(0).cast("bigint")

    # A bit of the index is the parity of the Gray code bits up to it.
    def index(x: Column) -> Column:
        def read(acc: Column, place: Column) -> Column:
            bit = (F.get(x, place.i).bitwiseAND(place.q) != 0).cast("bigint")
            parity = acc.parity.bitwiseXOR(bit)
            return F.struct((acc.index * 2 + parity).alias("index"), parity.alias("parity"))

        start = F.struct(zero.alias("index"), zero.alias("parity"))
        return F.aggregate(places, start, read, lambda acc: acc.index)

    return F.aggregate(steps, F.array(*[a.cast("bigint") for a in axes]), turn, index)


def _quantised_names(df: DataFrame, column: str, cell: str, bits: int) -> DataFrame:
    """Cells of equal width over the sorted distinct values of a column; null is a value of its own, first."""
    values = df.select(column).distinct().withColumn("_null", F.col(column).isNotNull())
    ranked = global_rank(values, ["_null", column], "_rank").drop("_null")
    total = ranked.agg(F.count("*").alias("_values"))
    cells = ranked.crossJoin(F.broadcast(total)).select(
        F.col(column).alias("_value"), F.floor(F.col("_rank") * (1 << bits) / F.col("_values")).cast("bigint").alias(cell))
    return df.join(cells, df[column].eqNullSafe(cells["_value"]), "left").drop("_value")


def hilbert_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: Sequence[str] = ("lang", "source"),
    shards: int = SHARDS, bits: int = BITS,
) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard, hilbert``: one row per document.

    Each name dimension (``lang`` and ``source`` unless others are given) is quantised by the rank of
    its value, the size by its logarithm. Documents are sorted by their place on the curve through
    these dimensions, equal texts side by side, and the order is cut into runs of as many rows, one
    more or less: law ``rows``. Files written from the runs have narrow ranges in every dimension.

    Size is the bytes of the text, none if null, plus 16. Slots count from 0 within a shard. Rows
    that agree in everything are interchangeable and fill as many slots as they are. With fewer
    rows than shards some shards are empty; an empty table gives no rows. ``grown_shard`` belongs
    to another law and is null.
    """
    names = list(dimensions)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"),
        *[F.col(n).cast("string").alias(f"_name{i}") for i, n in enumerate(names)],
    )
    for i in range(len(names)):
        rows = _quantised_names(rows, f"_name{i}", f"_cell{i}", bits)
    wide = F.floor(F.log2("size") * 2).cast("bigint")
    axes = [F.col(f"_cell{i}") for i in range(len(names))] + [F.least(wide, F.lit((1 << bits) - 1))]
    rows = rows.select("_id", "size", "text_crc32", "_hash", hilbert_index(axes, bits).alias("hilbert"))
    ranked = global_rank(rows, ["hilbert", "text_crc32", "_hash", "_id"], "_rank")
    total = ranked.agg(F.count("*").alias("_total"))
    placed = ranked.crossJoin(F.broadcast(total)).withColumn("shard", _quotient(F.col("_rank") * shards, F.col("_total")))
    first = _quotient(F.col("shard") * F.col("_total") + shards - 1, F.lit(shards).cast("bigint"))
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_rank") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def _quotient(over: Column, under: Column) -> Column:
    """Whole quotient of two long columns, without floating point."""
    return ((over - F.pmod(over, under)) / under).cast("bigint")
