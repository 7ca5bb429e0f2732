"""Batch completion of chat messages by a caller-supplied client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, lookup_join

# make_client() -> client(messages: list[dict], temperature: float | None) -> str
Client = Callable[[list, float | None], str]

NO_MESSAGES = "nothing to send"
# Prompts of one task where a ledger is kept; a task's replies are in the ledger once it ends.
BATCH = 50
LEDGER = "key string, reply string, error string, asked_at double"


def complete(
    df: DataFrame,
    make_client: Callable[[], Client],
    temperature: float | None = None,
    retries: int = 2,
    parallelism: int | None = None,
    messages_col: str = "messages",
    backoff: float = 0.0,
    ledger: str | None = None,
    batch: int = BATCH,
) -> DataFrame:
    """``df`` without its messages, plus ``reply`` and ``error``.

    One client per task. A row that still fails after its retries keeps a null
    reply and the error text, so the job goes on. A row without messages is not
    sent; its error is ``NO_MESSAGES``. ``retry_failed`` sends failed rows again.
    ``backoff`` is how many seconds pass before the second try; each further try waits twice as long.

    Without a ledger a lost executor repeats the calls of its tasks: write the result out before
    several readers use it. ``ledger`` names a folder that all executors share; see ``ask``.
    """
    if ledger is not None:
        return _from_ledger(df, make_client, temperature, retries, messages_col, backoff, ledger, batch)
    kept = [field for field in df.schema.fields if field.name != messages_col]
    names = [field.name for field in kept]
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in kept)
    schema = f"{schema}, reply string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            answers = [_asked(client, messages, temperature, retries, backoff) for messages in batch[messages_col]]
            yield batch[names].assign(reply=[a[0] for a in answers], error=[a[1] for a in answers])

    if parallelism is not None:
        df = df.repartition(parallelism)
    return df.mapInPandas(run, schema)


def _asked(client: Client, messages, temperature: float | None, retries: int, backoff: float) -> tuple[str | None, str | None]:
    """Reply and error of one prompt."""
    if messages is None:
        return None, NO_MESSAGES
    plain = [{"role": m["role"], "content": m["content"]} for m in messages]
    error = None
    for attempt in range(retries + 1):
        if attempt and backoff:
            time.sleep(backoff * 2 ** (attempt - 1))
        try:
            return client(plain, temperature), None
        except Exception as failure:
            error = f"{type(failure).__name__}: {failure}"
    return None, error


def prompt_key(messages: F.Column, temperature: float | None) -> F.Column:
    """SHA-256 of messages and temperature: equal prompts have one key."""
    return F.sha2(F.to_json(F.struct(messages.alias("messages"), F.lit(temperature).cast("double").alias("temperature"))), 256)


def read_ledger(spark, ledger: str) -> DataFrame:
    """``(key, reply, error)``: the reply of each key, or where there is none its last error."""
    rows = spark.read.schema(LEDGER).parquet(ledger)
    best = F.min_by(F.struct("reply", "error"), F.struct(F.col("error").isNotNull(), -F.col("asked_at")))
    return rows.groupBy("key").agg(best.alias("_best")).select("key", "_best.reply", "_best.error")


def ask(
    prompts: DataFrame, make_client: Callable[[], Client], ledger: str, temperature: float | None = None, retries: int = 2,
    backoff: float = 0.0, batch: int = BATCH,
) -> None:
    """Send the ``prompts(key, messages)`` that the ledger has no reply to, each key once.

    A task sends about ``batch`` prompts and its replies become part of the ledger when it ends, not
    when the job does. So a job that was killed half-way finds what it paid for when it starts again. Failed
    prompts are in the ledger with their error and are sent again by the next run.
    """
    spark = prompts.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)  # so that there is one to read
    done = read_ledger(spark, ledger).filter(F.col("error").isNull()).select("key")
    open_ = cut_lineage(
        prompts.filter(F.col("messages").isNotNull()).dropDuplicates(["key"]).join(done, "key", "left_anti"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for rows in batches:
            answers = [_asked(client, messages, temperature, retries, backoff) for messages in rows["messages"]]
            yield pd.DataFrame({
                "key": rows["key"], "reply": [a[0] for a in answers], "error": [a[1] for a in answers], "asked_at": time.time()})

    waiting = open_.count()
    if not waiting:
        return
    dealt = open_.repartition(-(-waiting // batch), "key").select("key", "messages")
    # version 2 publishes the files of a task when the task commits
    (dealt.mapInPandas(run, LEDGER).write.mode("append")
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(ledger))


def _from_ledger(df, make_client, temperature, retries, messages_col, backoff, ledger, batch) -> DataFrame:
    keyed = df.withColumn("_key", F.when(F.col(messages_col).isNotNull(), prompt_key(F.col(messages_col), temperature)))
    ask(keyed.select(F.col("_key").alias("key"), F.col(messages_col).alias("messages")),
        make_client, ledger, temperature, retries, backoff, batch)
    known = read_ledger(df.sparkSession, ledger).withColumnRenamed("key", "_key")
    wanted = known.join(keyed.select("_key").distinct(), "_key", "left_semi")
    rows = keyed.drop(messages_col).withColumn("_row", F.monotonically_increasing_id())
    error = F.when(F.col("_key").isNull(), F.lit(NO_MESSAGES)).otherwise(F.col("error"))
    return lookup_join(rows, wanted, ["_key"], "_row", "left").withColumn("error", error).drop("_key", "_row")


def retry_failed(df: DataFrame, replies: DataFrame, keys: Sequence[str], make_client: Callable[[], Client], **options) -> DataFrame:
    """``replies`` with its failed rows asked again; ``df`` holds their messages by ``keys``."""
    failed = replies.filter(F.col("error").isNotNull() & (F.col("error") != NO_MESSAGES))
    again = complete(df.join(failed.select(*keys), list(keys), "left_semi"), make_client, **options)
    done = replies.filter(F.col("error").isNull() | (F.col("error") == NO_MESSAGES))
    return done.unionByName(again)
