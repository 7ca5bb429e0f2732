"""Site profiles and comparisons end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.completion import complete
from ..operators.crawl import crawl_frontier, link_table, pages_of_hosts
from ..operators.prompts import comparison_messages, pair_sites, site_messages
from ..operators.report import site_report_lines
from ..operators.site import every_seed, page_fields, site_profile
from ..session import cut_lineage


def profile_sites(seeds: DataFrame, pages: DataFrame, max_depth: int = 2, max_pages: int = 10) -> DataFrame:
    """Walk and profile every seed; one that cannot be fetched has an empty profile."""
    # one pass over the pages: what is read more than once has no html
    parsed = cut_lineage(page_fields(pages_of_hosts(pages, seeds), "page_id", "url", with_links=True))
    walk = crawl_frontier(seeds, link_table(parsed), max_depth, max_pages)
    return every_seed(seeds, site_profile(walk, parsed))


def summarize_sites(
    seeds: DataFrame, pages: DataFrame, make_client: Callable, max_depth: int = 2, max_pages: int = 10,
    parallelism: int | None = None, **sending,
) -> DataFrame:
    """``(seed, summary, error)`` of every seed: walk, profile, prompt, completion.

    ``sending`` are further options of ``complete``, such as a ledger.
    """
    messages = site_messages(profile_sites(seeds, pages, max_depth, max_pages))
    replies = complete(messages, make_client, parallelism=parallelism, **sending)
    return cut_lineage(replies).select("seed", F.col("reply").alias("summary"), "error")


def compare_sites(
    pairs: DataFrame, pages: DataFrame, make_client: Callable, max_depth: int = 2, max_pages: int = 10,
    parallelism: int | None = None, **sending,
) -> DataFrame:
    """``site_report_lines`` of every ``(pair_id, seed_a, seed_b)``; no pair is left out."""
    seeds = pairs.select(F.col("seed_a").alias("seed")).union(pairs.select("seed_b")).distinct()
    paired = pair_sites(pairs, summarize_sites(seeds, pages, make_client, max_depth, max_pages, parallelism, **sending))
    replies = complete(comparison_messages(paired), make_client, parallelism=parallelism, **sending)
    comparisons = cut_lineage(replies).select("pair_id", F.col("reply").alias("comparison"), "error")
    return site_report_lines(paired, comparisons)
