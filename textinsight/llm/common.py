"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# White space as the contracts define it: space and the five ASCII controls from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"
# Bits of a monotonically increasing id that number the rows of one partition.
ROW_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a temporary one only where that is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="textinsight-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends and ids stay as they are.

    The files go when the driver's file system client closes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def id_remainder(doc_id: str, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number all rows from 0 in ``order`` without bringing them to one task.

    Range partitions are sorted and numbered on their own, then shifted by the sizes of those
    before them. Only those sizes, one row a partition, meet in one task.
    """
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    return (
        placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + inside).drop("_part", "_at", "_start")
    )
