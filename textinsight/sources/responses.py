"""Survey answers from tables, CSV files, pasted text and line input.

Every reader gives ``response_id`` and ``response``; the id carries list order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, strip
from ..operators.grouping import running_total
from ..session import cut_lineage, lookup_join
from .tables import read_table

# The cells pandas' CSV reader takes for null by default.
CSV_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_responses(spark: SparkSession, path: str, id_col: str, text_col: str) -> DataFrame:
    """Answers of a parquet table, one per row."""
    return read_table(spark, path, id_col).select(
        F.col(id_col).alias("response_id"), F.col(text_col).alias("response")
    )


def drop_null_responses(df: DataFrame, text_col: str = "response") -> DataFrame:
    return df.na.drop(subset=[text_col])


def strip_nonblank(df: DataFrame, text_col: str = "response") -> DataFrame:
    """Strip each answer and drop the blank ones."""
    return df.withColumn(text_col, strip(F.col(text_col))).filter(F.col(text_col) != "")


def read_responses_csv(
    spark: SparkSession, path: str, column: str = "Response", nulls: Sequence[str] = CSV_NULLS,
    quoted_lines: bool = True,
) -> DataFrame:
    """The answer column of CSV files with a header; null cells are dropped.

    ``response_id`` grows in file order but has gaps between partitions; the numbered answers are
    written out once, so that every reader sees the same ids. Files without line breaks inside
    quotes can be read in splits: say so with ``quoted_lines=False``.
    """
    rows = (
        spark.read.option("header", True)
        .option("multiLine", quoted_lines)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    answers = rows.select(
        F.monotonically_increasing_id().alias("response_id"),
        F.when(~F.col(column).isin(list(nulls)), F.col(column)).alias("response"),
    )
    return cut_lineage(drop_null_responses(answers))


def split_responses(df: DataFrame, id_cols: Sequence[str], text_col: str = "text") -> DataFrame:
    """Pasted text to one row per non-blank stripped line, with its line position."""
    lines = df.select(
        *id_cols, F.posexplode(F.split(F.col(text_col), LINE_BREAK)).alias("line_no", "response")
    )
    return strip_nonblank(lines.withColumn("line_no", F.col("line_no").cast("bigint")))


def lines_until_marker(
    df: DataFrame,
    source_cols: Sequence[str],
    line_no: str = "line_no",
    line: str = "line",
    marker: str = "END",
) -> DataFrame:
    """Per source, the stripped non-blank lines before the first marker line.

    The marker position is a plain aggregate and its join spreads each source by
    line, so one long source is still read by many tasks.
    """
    keys = list(source_cols)
    stripped = df.withColumn(line, strip(F.col(line)))
    stop = (
        stripped.filter(F.upper(F.col(line)) == marker.upper())
        .groupBy(*keys)
        .agg(F.min(line_no).alias("_stop"))
    )
    before = F.col("_stop").isNull() | (F.col(line_no) < F.col("_stop"))
    kept = lookup_join(stripped.filter(F.col(line) != ""), stop, keys, line_no, "left")
    return kept.filter(before).drop("_stop")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(file, line_no, line)``, ready for ``lines_until_marker``.

    Files are read in splits and numbered by split and place in the split, so no task holds a file.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), "value",
    )
    pieces = rows.select("file", "_block", "_at", F.posexplode(F.split("value", LINE_BREAK)).alias("_pos", "line"))
    numbered = running_total(cut_lineage(pieces.withColumn("_one", F.lit(1))), "file", ["_block", "_at", "_pos"], "_one", "line_no")
    return numbered.select("file", F.col("line_no").cast("bigint").alias("line_no"), "line")
