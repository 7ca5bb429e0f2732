"""Model replies to insight structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, cluster_title, strip_json_fence

INSIGHT = "struct<title:string,insight:string,actions:array<string>>"
# Fixed values of the fallback row.
NO_TITLE = "Undefined"
NO_INSIGHT = "Insight could not be generated."
NO_ACTIONS = "No actions available due to error."


def parse_insight(cluster: Column, reply: Column) -> Column:
    """``struct<title, insight, actions>`` of a reply.

    A reply that is not exactly one JSON object gives the fallback row; a
    missing or wrongly typed field gives the fallback of that field. Parsing it
    as the only element of an array rejects text after a valid object.
    """

    def fields(parsed: Column) -> Column:
        one = F.when(F.size(parsed) == 1, F.get(parsed, 0))
        return F.struct(
            F.coalesce(one["title"], cluster_title(cluster, F.lit(NO_TITLE))).alias("title"),
            F.coalesce(one["insight"], F.lit(NO_INSIGHT)).alias("insight"),
            F.coalesce(one["actions"], F.array(F.lit(NO_ACTIONS))).alias("actions"),
        )

    wrapped = F.concat(F.lit("["), strip_json_fence(reply), F.lit("]"))
    return bind(F.from_json(wrapped, f"array<{INSIGHT}>"), fields)
