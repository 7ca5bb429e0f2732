"""Session settings and the few execution helpers every operator shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Above this many rows, or bytes of its values as text, a lookup table is shuffled instead of broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Tasks one key of a shuffled lookup is spread over.
SALTS = 16
# Inputs of fewer splits than cores are spread over the cores first, up to this size.
SPREAD_BYTES = 512 * 1024 * 1024


def build_session(app_name: str = "textinsight", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small input at least one partition per core.

    A file cannot be split below its row groups, so a small table may come as one
    task. A table of more than ``SPREAD_BYTES``, or one that already has a partition per core, is
    left as it is: no shuffle of a large input, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _scan_bytes(df) > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def _scan_bytes(df: DataFrame) -> int:
    """Size of the input as Spark's optimizer estimates it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is made up only for a local master, where there is just
    one machine to lose.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="textinsight-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    ``build_session`` has Spark remove a checkpoint once nothing refers to it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a table and read it back, so that later filters skip parts of it.

    The files go when the driver's file system client closes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` returned and that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(file)).getParent()
        if folder.getName().startswith("table-"):
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def reclaim(spark: SparkSession) -> None:
    """Have the driver collect its garbage: only then does Spark delete shuffle files and checkpoints that are done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, keys: Sequence[str], placed: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as a table bucketed by ``keys`` and return it with its name in the catalog.

    Joins and groupings on the keys then read it as it lies, without a shuffle. There are as many
    buckets as shuffle partitions, and each is one file: rows are dealt out by the keys first, unless
    they are ``placed`` that way by a grouping. ``unbucketed`` takes the name out of the catalog.
    """
    spark = df.sparkSession
    name = f"textinsight_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if placed else df.repartition(buckets, *keys)
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    _delete_on_exit(spark, path)
    return spark.table(name), name


def unbucketed(spark: SparkSession, name: str) -> DataFrame:
    """The rows of a table that ``bucketed`` wrote, read from its files; the catalog forgets it."""
    path = f"{shared_folder(spark)}/{name}"
    schema = spark.table(name).schema
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.read.schema(schema).parquet(path)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table may be broadcast. It is counted and measured, so cut its lineage first."""
    if df.count() > max_rows:
        return False
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its row count allows it, else as it is."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: str, how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a table that has few rows per key, whatever share of ``left`` one key holds.

    ``right`` is broadcast when it has at most ``max_rows`` rows. A larger one is
    joined by shuffle, each key spread over ``SALTS`` tasks by ``spread_by``.
    """
    on, right = list(on), cut_lineage(right)
    if is_small(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread_by)), F.lit(SALTS)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    # Spark sizes the copies like one of them and might broadcast all after all
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
