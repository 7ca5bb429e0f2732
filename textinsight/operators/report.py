"""Report tables and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_clean, bullet_join, cluster_title, keyword_line
from .keywords import nested_keywords

KEYWORDS = "array<struct<term:string,score:double>>"
# Fixed values of the report.
REPORT_TITLE = "Customer Feedback Analysis Report"
INSIGHT_LABEL = "Insights:"
ACTIONS_LABEL = "Action Suggestions:"


def attach_keywords(insights: DataFrame, keywords: DataFrame, group: str = "cluster") -> DataFrame:
    """Ranked keywords per cluster, an empty list when there are none.

    Both sides have one row per cluster.
    """
    nested = nested_keywords(keywords, group).withColumnRenamed(group, "_group")
    return insights.join(nested, insights[group].eqNullSafe(F.col("_group")), "left").drop("_group").withColumn(
        "keywords", F.coalesce("keywords", F.array().cast(KEYWORDS))
    )


def build_report(insights: DataFrame, keywords: DataFrame, group: str = "cluster") -> DataFrame:
    """``(cluster, title, body, keyword_line)`` in cluster order.

    ``insights`` has ``cluster`` and ``parsed`` (see ``parse_insight``). Title and
    body are ASCII only; the keyword line is left as it is.
    """
    body = F.concat(
        F.lit(f"{INSIGHT_LABEL}\n"), F.col("parsed.insight"),
        F.lit(f"\n\n{ACTIONS_LABEL}\n"), bullet_join(F.col("parsed.actions")),
    )
    return (
        attach_keywords(insights, keywords, group)
        .select(
            group,
            ascii_clean(cluster_title(F.col(group), F.col("parsed.title"))).alias("title"),
            ascii_clean(body).alias("body"),
            keyword_line(F.col("keywords")).alias("keyword_line"),
        )
        .orderBy(group)
    )


def report_lines(report: DataFrame, survey_name: str, question: str, group: str = "cluster") -> DataFrame:
    """``(section, <group>, line)``: the header as section 0, then one section 1 per cluster, as text.

    Sorted by section and group the lines are in order, whatever type the group has.
    """
    header = report.sparkSession.range(1).select(
        F.lit(0).alias("section"),
        F.lit(None).cast(report.schema[group].dataType).alias(group),
        F.concat_ws(
            "\n", F.lit(REPORT_TITLE), F.lit(f"Survey: {survey_name}"), F.lit(f"Question: {question}"), F.lit("")
        ).alias("line"),
    )
    sections = report.select(
        F.lit(1).alias("section"), group, F.concat_ws("\n", "title", "body", "keyword_line", F.lit("")).alias("line"),
    )
    return header.unionByName(sections)


def write_report(
    report: DataFrame, path: str, survey_name: str, question: str, fmt: str = "text", group: str = "cluster"
) -> None:
    """Header and one section per cluster, in order of the group over the files' names."""
    if fmt == "text":
        lines = report_lines(report, survey_name, question, group)
        ordered = lines.repartitionByRange("section", group).sortWithinPartitions("section", group)
        ordered.select("line").write.mode("overwrite").text(path)
    else:
        named = report.withColumn("survey_name", F.lit(survey_name)).withColumn("question", F.lit(question))
        named.write.mode("overwrite").format(fmt).save(path)


def site_report_lines(paired: DataFrame, comparisons: DataFrame) -> DataFrame:
    """``(pair_id, seq, side, kind, line, error)``: both summaries and the comparison of each pair.

    ``side`` is ``a``, ``b`` or ``both``. What could not be had is an empty line with its ``error``.
    """
    compared = comparisons.select("pair_id", "comparison", F.col("error").alias("_error"))
    joined = paired.join(compared, "pair_id", "left")
    row = lambda side, kind, line, error: F.struct(
        F.lit(side).alias("side"), F.lit(kind).alias("kind"), F.coalesce(line, F.lit("")).alias("line"), error.alias("error"))
    none = F.lit(None).cast("string")
    rows = F.array(
        row("a", "seed", F.col("seed_a"), none), row("a", "summary", F.col("summary_a"), F.col("error_a")),
        row("b", "seed", F.col("seed_b"), none), row("b", "summary", F.col("summary_b"), F.col("error_b")),
        row("both", "comparison", F.col("comparison"), F.col("_error")),
    )
    return joined.select("pair_id", F.posexplode(rows).alias("seq", "row")).select(
        "pair_id", F.col("seq").cast("bigint").alias("seq"), "row.side", "row.kind", "row.line", "row.error")


def write_site_report(lines: DataFrame, path: str) -> None:
    """Text files whose lines are in pair and line order, each after its side and kind."""
    ordered = lines.repartitionByRange("pair_id").sortWithinPartitions("pair_id", "seq")
    text = F.concat_ws(" ", F.concat("side", F.lit(" "), "kind", F.lit(":")), "line", F.concat(F.lit("("), "error", F.lit(")")))
    ordered.select(text.alias("value")).write.mode("overwrite").text(path)
