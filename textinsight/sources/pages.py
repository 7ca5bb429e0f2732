"""Web pages from a table that stands in for HTTP fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, small_side
from .tables import read_table


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``pages(page_id, url, html)``; a page without content is a failed fetch."""
    pages = read_table(spark, path, "page_id").select("page_id", "url", "html")
    return pages.filter(F.col("url").isNotNull() & F.col("html").isNotNull())


def fetch(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of ``urls`` with their page; a URL that has none drops out.

    Of several pages with one URL the lowest ``page_id`` counts, as in a walk. The choice is made on
    ids; pages move only where the URLs are too many to broadcast.
    """
    first = pages.groupBy("url").agg(F.min("page_id").alias("_first"))
    wanted = small_side(cut_lineage(urls.join(first, "url")))
    content = pages.select(F.col("page_id").alias("_page"), "html")
    return wanted.join(content, F.col("_first") == F.col("_page")).drop("_first", "_page")
