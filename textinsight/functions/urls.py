"""URL expressions, following RFC 3986 as Python's ``urllib.parse`` applies it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
HAS_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
FRAGMENT = r"(?s)^[^#]*#(.*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def netloc(url: Column) -> Column:
    """Authority part with user and port kept; empty when there is none. Never raises."""
    return F.regexp_extract(url, AUTHORITY, 1)


def same_host(url: Column, other: Column) -> Column:
    return netloc(url) == netloc(other)


def _fold_dots(segments: Column) -> Column:
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, segment: F.when(segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(segment == ".", done)
        .otherwise(F.concat(done, F.array(segment))),
    )
    closes_folder = F.element_at(segments, -1).isin(".", "..")
    return F.when(closes_folder, F.concat(folded, F.array(F.lit("")))).otherwise(folded)


def _merged_path(base_path: Column, path: Column) -> Column:
    """Path of a reference that has one of its own."""

    def relative(base_parts: Column) -> Column:
        kept = F.when(
            F.element_at(base_parts, -1) == "", base_parts
        ).otherwise(F.slice(base_parts, F.lit(1), F.size(base_parts) - 1))
        joined = F.concat(kept, F.split(path, "/"))
        return bind(
            joined,
            lambda parts: F.filter(
                parts, lambda part, i: (i == 0) | (i == F.size(parts) - 1) | (part != "")
            ),
        )

    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(
        bind(F.split(base_path, "/"), relative)
    )
    merged = F.array_join(bind(segments, _fold_dots), "/")
    # An absolute path without dot segments is final as it stands.
    return F.when(path.startswith("/") & ~path.rlike(r"/\."), path).otherwise(
        F.when(merged == "", "/").otherwise(merged)
    )


def _parts(url: Column) -> Column:
    return F.struct(
        scheme(url).alias("scheme"),
        url.rlike(HAS_AUTHORITY).alias("has_host"),
        netloc(url).alias("host"),
        F.regexp_extract(url, PATH, 1).alias("path"),
        F.regexp_extract(url, QUERY, 1).alias("query"),
        F.regexp_extract(url, FRAGMENT, 1).alias("fragment"),
    )


def _resolve(base: Column, ref: Column) -> Column:
    """Resolve the parts of a reference that has the scheme of its base."""
    empty_path = ~ref["has_host"] & (ref["path"] == "")
    path = (
        F.when(ref["has_host"], ref["path"])
        .when(ref["path"] == "", base["path"])
        .otherwise(_merged_path(base["path"], ref["path"]))
    )
    query = F.when(empty_path & (ref["query"] == ""), base["query"]).otherwise(ref["query"])
    rooted = bind(
        path, lambda p: F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
    )
    return F.concat(
        base["scheme"],
        F.lit("://"),
        F.when(ref["has_host"], ref["host"]).otherwise(base["host"]),
        rooted,
        bind(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")),
        F.when(ref["fragment"] != "", F.concat(F.lit("#"), ref["fragment"])).otherwise(""),
    )


def url_join(base: Column, reference: Column) -> Column:
    """Resolve ``reference`` against the page URL ``base``."""
    cleaned = F.regexp_replace(F.regexp_replace(reference, r"^[\x00- ]+", ""), r"[\t\r\n]", "")

    def joined(pair: Column) -> Column:
        base_parts, ref = pair["base"], pair["ref"]
        foreign = (ref["scheme"] != "") & (ref["scheme"] != base_parts["scheme"])
        return (
            F.when(reference == "", base)
            .when(foreign | ~base_parts["scheme"].isin("http", "https"), reference)
            .otherwise(_resolve(base_parts, ref))
        )

    return bind(F.struct(_parts(base).alias("base"), _parts(cleaned).alias("ref")), joined)
