"""Survey insight end to end."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_insight
from ..functions.text import bullet_join
from ..operators.completion import complete
from ..operators.grouping import PART_CHARS, group_responses, merge_parts
from ..operators.keywords import cluster_keywords
from ..operators.kmeans import kmeans_cluster
from ..operators.prompts import cluster_messages
from ..operators.report import build_report
from ..operators.sentiment import DEFAULT_INTENSIFIERS, DEFAULT_LEXICON, DEFAULT_NEGATORS, with_sentiment
from ..session import cut_lineage
from ..sources.responses import drop_null_responses

TEMPERATURE = 0.5
# Findings merged by one completion.
FAN_IN = 8


@dataclass(frozen=True)
class SurveyInsight:
    clustered: DataFrame
    keywords: DataFrame
    insights: DataFrame
    report: DataFrame


def summarize_clusters(
    df: DataFrame, survey_name: str, question: str, make_client: Callable, group: str = "cluster",
    id_col: str = "response_id", text_col: str = "response", part_chars: int = PART_CHARS,
    parallelism: int | None = None, **sending,
) -> DataFrame:
    """``(cluster, parsed, error)``: one insight per cluster, null being one, over all of its answers.

    The answers of a cluster are cut into parts of ``part_chars`` characters, one completion each.
    A cluster of several parts is a tree: the findings of ``FAN_IN`` neighbouring parts are the
    answers of one completion of the next round, until one finding is left. A part whose completion
    failed is left out of the merge, and ``error`` has the failures of the cluster, how many there
    were and the first of them; ``retry_failed`` can ask failed rows again. A cluster without any
    finding has the fallback insight. ``sending`` are further options of ``complete``, such as a ledger.
    """
    groups = group_responses(df.select(group, id_col, text_col), group, id_col, text_col, part_chars)
    finished, failures = None, None
    while True:
        groups = cut_lineage(groups)
        replies = complete(
            cluster_messages(groups, survey_name, question, group), make_client, TEMPERATURE, parallelism=parallelism,
            **sending,
        )
        # completions are paid for once, then read from the checkpoint
        parsed = cut_lineage(replies.select(
            group, "part", "error", parse_insight(F.coalesce(F.col(group).cast("string"), F.lit("none")), F.col("reply")).alias("parsed")))
        failed = parsed.filter(F.col("error").isNotNull()).select(group, "error")
        failures = failed if failures is None else failures.unionByName(failed)
        stats = parsed.groupBy(F.col(group).alias("_group")).agg(
            F.count(F.lit(1)).alias("_parts"), F.count(F.when(F.col("error").isNull(), 1)).alias("_good"), F.min("part").alias("_first"))
        counted = parsed.join(stats, parsed[group].eqNullSafe(F.col("_group")))
        alone = (F.col("_parts") == 1) | ((F.col("_good") == 0) & (F.col("part") == F.col("_first")))
        single = counted.filter(alone).select(group, "parsed")
        finished = single if finished is None else finished.unionByName(single)
        open_parts = counted.filter((F.col("_parts") > 1) & F.col("error").isNull())
        if open_parts.isEmpty():
            break
        finding = F.concat_ws("\n", "parsed.title", "parsed.insight", bullet_join(F.col("parsed.actions")))
        groups = merge_parts(open_parts.select(group, "part", finding.alias("response")), FAN_IN, group)
    summed = failures.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"), F.min("error").alias("_error"))
    return finished.join(summed, finished[group].eqNullSafe(F.col("_group")), "left").select(
        group, "parsed", F.when(F.col("_n") > 0, F.concat(F.col("_n").cast("string"), F.lit(" failed: "), "_error")).alias("error"))


def analyze_survey(
    responses: DataFrame,
    survey_name: str,
    question: str,
    make_client: Callable,
    k: int = 3,
    seed: int = 42,
    max_keywords: int = 15,
    stop_words: Sequence[str] | None = None,
    lexicon: Mapping[str, float] = DEFAULT_LEXICON,
    negators: Sequence[str] = DEFAULT_NEGATORS,
    part_chars: int = PART_CHARS,
    intensifiers: Mapping[str, float] = DEFAULT_INTENSIFIERS,
    **sending,
) -> SurveyInsight:
    """Cluster, score, rank keywords, summarise and report ``(response_id, response)`` rows.

    ``sending`` are further options of ``complete``, such as a ledger.
    """
    responses = drop_null_responses(responses, "response")
    # three branches read the clustered answers
    clustered = cut_lineage(with_sentiment(kmeans_cluster(responses, k, seed, stop_words=stop_words),
                                           lexicon=lexicon, negators=negators, intensifiers=intensifiers, reach=1))
    keywords = cluster_keywords(clustered, top_n=max_keywords, stop_words=stop_words)
    insights = summarize_clusters(clustered, survey_name, question, make_client, part_chars=part_chars, **sending)
    return SurveyInsight(clustered, keywords, insights, build_report(insights, keywords))
