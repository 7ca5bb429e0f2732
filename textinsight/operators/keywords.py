"""Keyword rankings per cluster and per site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exploded, keyword_counts
from .tfidf import tfidf_by_group

# Scores are rounded before they are ranked, so that equal sums stay equal.
SCORE_DIGITS = 9


def term_scores(weights: DataFrame, group: str = "cluster") -> DataFrame:
    """Column sums of the TF-IDF rows of each group."""
    return weights.groupBy(group, "term").agg(F.round(F.sum("weight"), SCORE_DIGITS).alias("score"))


def top_terms(scores: DataFrame, group: str = "cluster", top_n: int = 15) -> DataFrame:
    """The best ``top_n`` terms of each group; ties in term order."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), F.asc("term"))
    ranked = scores.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank") <= top_n).select(group, "rank", "term", "score")


def cluster_keywords(
    df: DataFrame,
    group: str = "cluster",
    id_col: str = "response_id",
    text_col: str = "response",
    top_n: int = 15,
    max_features: int = 100,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """``(group, rank, term, score)`` for all groups in one job."""
    weights = tfidf_by_group(df, group, id_col, text_col, stop_words, max_features)
    return top_terms(term_scores(weights, group), group, top_n)


def nested_keywords(keywords: DataFrame, group: str = "cluster") -> DataFrame:
    """One row per group with its ranked ``array<struct<term, score>>`` (``top_n`` items)."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "term", "score")))
    return keywords.groupBy(group).agg(ranked.alias("_ranked")).select(
        group,
        F.transform(
            "_ranked", lambda item: F.struct(item["term"].alias("term"), item["score"].alias("score"))
        ).alias("keywords"),
    )


def word_counts(
    df: DataFrame, group: str, order_col: str, text_col: str = "text", min_chars: int = 4,
    skip_prefixes: Sequence[str] = ("http", "www"),
) -> DataFrame:
    """``(group, word, n, first_seen)``; ``first_seen`` is (page order, word position).

    A page counts its own words first, so one row per page and word is shuffled.
    """
    rows = exploded(df, [group, order_col], keyword_counts(F.col(text_col), min_chars, skip_prefixes), "_count")
    return rows.groupBy(group, F.col("_count.word").alias("word")).agg(
        F.sum("_count.n").alias("n"), F.min(F.struct(order_col, "_count.pos")).alias("first_seen")
    )


def top_words(counts: DataFrame, group: str, top_n: int = 20) -> DataFrame:
    """The best ``top_n`` words of each group; ties in first-seen order."""
    order = Window.partitionBy(group).orderBy(F.desc("n"), F.asc("first_seen"))
    ranked = counts.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank") <= top_n).select(group, "rank", "word", "n")


def site_keywords(
    df: DataFrame, group: str = "seed", order_col: str = "ord", text_col: str = "text",
    min_chars: int = 4, top_n: int = 20,
) -> DataFrame:
    """``(group, rank, word, n)`` of the most frequent words of each site."""
    return top_words(word_counts(df, group, order_col, text_col, min_chars), group, top_n)
