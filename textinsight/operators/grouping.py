"""Ordered groups that may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, small_side

# Characters of answers in one part of a group.
PART_CHARS = 200_000
# Characters a prompt adds to each answer.
ANSWER_EXTRA = 3


def distinct_clusters(df: DataFrame, group: str = "cluster") -> DataFrame:
    return df.select(group).distinct().orderBy(group)


def filter_cluster(df: DataFrame, value, group: str = "cluster") -> DataFrame:
    """The rows of one cluster. Work on all clusters groups by the column instead."""
    return df.filter(F.col(group) == value)


def running_total(df: DataFrame, group: str, order_cols: Sequence[str], value: str, out: str = "total") -> DataFrame:
    """Exclusive running total of ``value`` inside each group, null being one, in the order given.

    A group is cut into range slices that are summed first, so that no task
    walks a whole group: a slice adds the total of the slices before it to its
    own running total.
    """
    ranged = df.repartitionByRange(F.col(group), *order_cols).withColumn("_slice", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # fixes which row is in which slice
    slices = ranged.groupBy(group, "_slice").agg(F.sum(value).alias("_sum"))
    # one row per slice of a group
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        F.col(group).alias("_group"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_slice").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    same = ranged[group].eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_of"))
    return (
        ranged.join(small_side(cut_lineage(offsets)), same)
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_slice", "_offset", "_group", "_of")
    )


def with_parts(
    df: DataFrame, group: str = "cluster", id_col: str = "response_id", text_col: str = "response",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """``(group, id, piece, text, part)``: a new part begins every ``part_chars`` characters.

    An answer counts its length and the ``ANSWER_EXTRA`` characters that a prompt adds to it, so
    also empty answers fill a part. One longer than a part is cut into pieces. Null counts as
    empty. Positions are worked out on ids and lengths only; the text joins by id.
    """
    room = max(1, part_chars - ANSWER_EXTRA)
    answers = df.select(group, id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    last = F.greatest(F.lit(0), F.ceil(F.length(text_col) / room).cast("int") - 1)
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text_col), i * room + 1, F.lit(room)))
    cut = answers.select(group, id_col, F.posexplode_outer(pieces).alias("piece", text_col))
    sizes = cut.select(group, id_col, "piece", (F.length(text_col) + ANSWER_EXTRA).cast("bigint").alias("_chars"))
    total = running_total(sizes, group, [id_col, "piece"], "_chars", "_total")
    parts = total.select(
        F.col(group).alias("_group"), F.col(id_col).alias("_id"), F.col("piece").alias("_piece"),
        F.floor(F.col("_total") / part_chars).alias("part"))
    same = cut[group].eqNullSafe(F.col("_group")) & cut[id_col].eqNullSafe(F.col("_id")) & (F.col("piece") == F.col("_piece"))
    return cut.join(parts, same).drop("_group", "_id", "_piece")


def group_responses(
    df: DataFrame, group: str = "cluster", id_col: str = "response_id", text_col: str = "response",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """``(group, part, n, responses)``: the ordered answers of each group, null being a group.

    A group of up to ``part_chars`` characters is one row. A larger one is several rows that
    together hold every answer once, in order; no row has more than twice ``part_chars``.
    """
    parts = with_parts(df, group, id_col, text_col, part_chars)
    return _listed(parts, group, [id_col, "piece"], text_col)


def _listed(parts: DataFrame, group: str, order_cols: Sequence[str], text_col: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(*order_cols, text_col)))
    return parts.groupBy(group, "part").agg(ordered.alias("_items")).select(
        group,
        "part",
        F.size("_items").cast("bigint").alias("n"),
        F.transform("_items", lambda item: item[text_col]).alias("responses"),
    )


def merge_parts(findings: DataFrame, fan_in: int, group: str = "cluster", text_col: str = "response") -> DataFrame:
    """``(group, part, n, responses)``: ``fan_in`` neighbouring parts of a group become one."""
    moved = findings.select(group, F.col("part").alias("_from"), F.floor(F.col("part") / fan_in).alias("part"), text_col)
    return _listed(moved, group, ["_from"], text_col)
