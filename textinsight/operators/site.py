"""Page fields and their merge into one profile per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import top_keywords
from ..session import cut_lineage, is_small
from .crawl import local_links


def page_fields(pages: DataFrame, *keep: str, with_links: bool = False) -> DataFrame:
    """``title, meta_description, h1, text, structured_data`` of each page, and its ``links`` if asked for.

    ``text`` is null for a page without a body.
    """
    source = ["html", "url"] if with_links and "url" not in keep else ["html"]
    marked = pages.select(*keep, *source, H.visible_markup(F.col("html")).alias("_markup"))
    markup = F.col("_markup")
    return marked.select(
        *keep,
        *([local_links(F.col("url"), markup).alias("links")] if with_links else []),
        H.title(markup).alias("title"),
        H.meta_description(markup).alias("meta_description"),
        H.h1_texts(markup).alias("h1"),
        H.body_text(markup).alias("text"),
        H.valid_json(H.json_ld(F.col("html"))).alias("structured_data"),
    )


def first_nonempty(fields: DataFrame, column: str, group: str = "seed", order_col: str = "ord") -> DataFrame:
    """First non-empty value of a column in walk order, empty when there is none."""
    filled = F.col(column) != ""
    return fields.groupBy(group).agg(
        F.coalesce(F.min_by(F.when(filled, F.col(column)), F.when(filled, F.col(order_col))), F.lit("")).alias(column)
    )


def concat_site(fields: DataFrame, group: str = "seed", order_col: str = "ord") -> DataFrame:
    """Headings, text and structured data of a site in walk order.

    One row holds the pages of one walk, whose number ``max_pages`` bounds.
    """
    ordered = F.sort_array(F.collect_list(F.struct(order_col, "h1", "text", "structured_data")))
    merged = fields.groupBy(group).agg(ordered.alias("_pages"))
    return merged.select(group, *_merged(F.col("_pages")))


def _merged(pages: Column) -> list[Column]:
    texts = F.transform(pages, lambda page: F.coalesce(F.concat(page["text"], F.lit("\n")), F.lit("")))
    return [
        F.flatten(F.transform(pages, lambda page: page["h1"])).alias("h1"),
        F.array_join(texts, "").alias("text"),
        F.flatten(F.transform(pages, lambda page: page["structured_data"])).alias("structured_data"),
    ]


def crawled_fields(walk: DataFrame, pages: DataFrame) -> DataFrame:
    """Page fields of the fetched pages only: ``(seed, ord, ...)``.

    ``pages`` has ``html``, or the fields already. A walk that may be broadcast spares the pages a
    shuffle; else the fields are worked out first, so that html never moves.
    """
    walked = cut_lineage(walk.select("seed", "ord", "page_id"))
    small = is_small(walked)
    if "html" in pages.columns and small:
        return page_fields(pages.select("page_id", "html").join(F.broadcast(walked), "page_id"), "seed", "ord")
    fields = pages.drop("url", "links") if "html" not in pages.columns else page_fields(pages, "page_id")
    return fields.join(F.broadcast(walked) if small else walked, "page_id").drop("page_id")


def site_profile(walk: DataFrame, pages: DataFrame, min_len: int = 4, top_n: int = 20) -> DataFrame:
    """One row per seed: ``title, meta_description, h1, text, structured_data, keywords``.

    The pages of a walk meet once, by seed; everything else happens in that row.
    """
    fields = crawled_fields(walk, pages)
    ordered = F.sort_array(
        F.collect_list(F.struct("ord", "title", "meta_description", "h1", "text", "structured_data"))
    )
    merged = fields.groupBy("seed").agg(ordered.alias("_pages"))

    def first_filled(name: str) -> Column:
        values = F.filter(F.transform("_pages", lambda page: page[name]), lambda value: value != "")
        return F.coalesce(F.get(values, 0), F.lit("")).alias(name)

    profile = merged.select(
        "seed", first_filled("title"), first_filled("meta_description"), *_merged(F.col("_pages"))
    )
    return profile.withColumn("keywords", top_keywords(F.col("text"), min_len, top_n))


def every_seed(seeds: DataFrame, profiles: DataFrame) -> DataFrame:
    """One profile per distinct seed, an empty one where no page could be fetched."""
    rows = seeds.select("seed").distinct().join(profiles, "seed", "left")
    empty = {
        field.name: F.coalesce(F.col(field.name), F.lit("") if field.dataType.simpleString() == "string" else F.array().cast(field.dataType))
        for field in profiles.schema.fields if field.name != "seed"
    }
    return rows.withColumns(empty)
