"""Breadth-first walk over same-host links, for all seeds at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.urls import netloc, same_host, url_join
from ..session import bucketed, cut_lineage, is_small, lookup_join, small_side, unbucketed


def html_links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, pos, href)``: every anchor in document order."""
    markup = pages.select("page_id", "url", H.visible_markup(F.col("html")).alias("_markup"))
    rows = markup.select("page_id", "url", F.posexplode(H.links(F.col("_markup"))).alias("pos", "href"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def local_links(url: Column, markup: Column) -> Column:
    """Targets of a page on its own host, each at its first position only."""
    targets = F.transform(H.links(markup), lambda href: url_join(url, href))
    return F.array_distinct(F.filter(targets, lambda target: same_host(target, url)))


def pages_of_hosts(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """The pages on a host of a seed, where the hosts are few enough to broadcast; else all pages.

    Either way no page moves. A walk drops the other hosts from the compact link table later.
    """
    hosts = cut_lineage(seeds.select(netloc(F.col("seed")).alias("_host")).distinct())
    if not is_small(hosts):
        return pages
    return pages.withColumn("_host", netloc(F.col("url"))).join(F.broadcast(hosts), "_host", "left_semi").drop("_host")


def link_table(pages: DataFrame) -> DataFrame:
    """``(url, page_id, links)``: the same-host targets of each fetched page.

    A walk never leaves the host of its seed, so links to other hosts are dropped
    here. Of several pages with one URL the lowest ``page_id`` counts. ``pages``
    has ``html``, or its ``links`` already.
    """
    if "links" in pages.columns:
        local = pages.select("page_id", "url", "links")
    else:
        markup = pages.select("page_id", "url", H.visible_markup(F.col("html")).alias("_markup"))
        local = markup.select("page_id", "url", local_links(F.col("url"), F.col("_markup")).alias("links"))
    return local.groupBy("url").agg(
        F.min("page_id").alias("page_id"), F.min_by("links", "page_id").alias("links")
    )


def drop_visited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Frontier rows whose (seed, url) was not seen before."""
    return frontier.join(visited.select("seed", "url"), ["seed", "url"], "left_anti")


def add_visited(visited: DataFrame, frontier: DataFrame) -> DataFrame:
    """Visited set with the frontier added, each (seed, url) once with its lowest ``ord``."""
    both = visited.select("seed", "url", "ord").unionByName(frontier.select("seed", "url", "ord"))
    return both.groupBy("seed", "url").agg(F.min("ord").alias("ord"))


def limit_pages(walk: DataFrame, max_pages: int) -> DataFrame:
    """The first ``max_pages`` fetched pages of each seed."""
    order = Window.partitionBy("seed").orderBy("ord")
    return walk.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_pages).drop("_n")


def wanted_pages(table: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of a link table that a frontier wants, each once.

    ``table`` is bucketed by URL, so it is read as it lies: only the URLs of the frontier move, and
    they are distinct, however many seeds want one.
    """
    return table.join(found.select("url").distinct(), "url")


def crawl_frontier(
    seeds: DataFrame, table: DataFrame, max_depth: int = 2, max_pages: int = 10
) -> DataFrame:
    """``(seed, ord, depth, url, page_id)``: the pages each walk fetches, in walk order.

    ``table`` is a ``link_table``. One step handles one depth of all seeds. A
    page's place is (depth, place of its parent, position of the link), which is
    the order a first-in-first-out queue would give. At most ``max_pages`` rows
    per seed go from one depth to the next: a later page is never fetched, so
    neither is anything it links to.

    The link table is written once, bucketed by URL, and no depth shuffles it again. The rows of a
    depth are bucketed by (seed, URL), as the frontier is grouped, to be compared with it where they
    lie. A URL that very many seeds want is fetched once and then meets their rows salted by seed.
    """
    spark = seeds.sparkSession
    hosts = small_side(cut_lineage(seeds.select(netloc(F.col("seed")).alias("_host")).distinct()))
    table = table.withColumn("_host", netloc(F.col("url"))).join(hosts, "_host", "left_semi").drop("_host")
    table, links_name = bucketed(table, ["url"])

    found = seeds.select("seed").distinct().select(
        "seed", F.col("seed").alias("url"), F.lit(0).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("pos")
    )
    levels: list[tuple[DataFrame, str]] = []
    before = None  # pages of each seed so far
    for depth in range(max_depth + 1):
        for visited, _ in levels:
            found = drop_visited(found, visited)
        order = Window.partitionBy("seed").orderBy("parent", "pos")
        fetched = lookup_join(found, wanted_pages(table, found), ["url"], "seed")
        fetched = fetched.withColumn("_n", F.row_number().over(order).cast("bigint")).filter(F.col("_n") <= max_pages)
        start = F.lit(0).cast("bigint")
        if before is not None:
            fetched = fetched.join(before, "seed", "left")
            start = F.coalesce(F.col("_before"), start)
        level = fetched.select(
            "seed", (start + F.col("_n")).alias("ord"), F.lit(depth).cast("bigint").alias("depth"),
            "url", "page_id", "links",
        ).filter(F.col("ord") <= max_pages)
        level, name = bucketed(level, ["seed", "url"])
        levels.append((level, name))
        if depth == max_depth:
            break
        before = reduce(DataFrame.unionByName, [rows.select("seed") for rows, _ in levels]).groupBy("seed").agg(
            F.count(F.lit(1)).alias("_before"))
        # a seed that has all its pages is done
        full = level.filter(F.col("ord") == max_pages).select("seed")
        level = level.join(full, "seed", "left_anti")
        if level.isEmpty():
            break
        # (parent, pos) of the first link to each URL
        found = (
            level.select("seed", F.col("ord").alias("parent"), F.posexplode("links").alias("pos", "url"))
            .groupBy("seed", "url")
            .agg(F.min(F.struct("parent", F.col("pos").cast("bigint").alias("pos"))).alias("_at"))
            .select("seed", "url", "_at.parent", "_at.pos")
        )
    spark.sql(f"DROP TABLE IF EXISTS {links_name}")
    return reduce(DataFrame.unionByName, [unbucketed(spark, name).drop("links") for _, name in levels])
