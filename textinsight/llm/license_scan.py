"""License mentions by diagonal voting."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textinsight.llm.common import ascii_lower

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Fixed phrases and their labels; a place counts where the words stand consecutively.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further templates, found also where a few words were changed, dropped or put in.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu affero general public license version 3": "agpl-3",
    "licensed under the gnu lesser general public license version": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
}
GRAM = 3
SLACK = 2
COVERAGE = 0.8


def _template_rows(base: Mapping[str, str], templates: Mapping[str, str], gram: int) -> list[tuple]:
    rows = []
    for exact, texts in ((True, base), (False, templates)):
        for text, label in texts.items():
            words = re.split(NO_WORD, text.lower())
            grams = len(words) - gram + 1
            if not 1 <= grams <= 63:
                raise ValueError(f"a template has {gram} to {gram + 62} words: {text!r}")
            rows += [(text, label, exact, grams, at, words[at : at + gram]) for at in range(grams)]
    return rows


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Mapping[str, str] = BASE_PHRASES,
    templates: Mapping[str, str] = TEMPLATES, gram: int = GRAM, slack: int = SLACK, coverage: float = COVERAGE,
) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score``: one row per document.

    The hashes of all rolling word k-grams of all texts are joined to the k-grams of the templates
    (a table as large as the templates, so broadcast), and their words compared. A match votes for
    a diagonal: place in the text less place in the template. Votes are gathered per document,
    template and diagonal; diagonals not more than ``slack`` apart become one span, as words put
    in or dropped shift the rest. A span of a template counts where ``coverage`` of the template's
    k-grams stand in at most twice its length, its closing one (which names the version) among
    them; a base phrase counts only whole, on one diagonal.

    Words are runs of non-ASCII characters, digits and letters after A-Z were lower-cased; null
    counts as empty. A document without a match has zero counts, null places, empty labels and
    score 0; else the score is the share of k-grams of its best span. Only votes are shuffled; a
    marker keeps each document, also without votes. Rows that agree in id and text are scanned as
    one and come out as many times as they came in.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(
        _template_rows(base, templates, gram),
        "template string, label string, exact boolean, grams int, tpos int, words array<string>",
    ).withColumn("hash", F.xxhash64(*[F.col("words")[i] for i in range(gram)])).withColumnRenamed("words", "template_words")
    split = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
        F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), NO_WORD), "").alias("words"),
    )
    hashes = F.when(F.size("words") >= gram, F.transform(
        F.sequence(F.lit(0), F.size("words") - gram),
        lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(gram)]),
    )).otherwise(F.array().cast("array<bigint>"))
    marked = F.concat(F.array(F.lit(None).cast("bigint")), hashes)  # the null at the front marks the document
    grams = split.select("id", "text_hash", "words", F.size("words").alias("n_words"), marked.alias("marked")).select(
        "id", "text_hash", "words", "n_words", F.posexplode_outer("marked").alias("at", "hash"))
    same = F.slice("words", F.greatest(F.col("at"), F.lit(1)), gram) == F.col("template_words")
    votes = (
        grams.join(F.broadcast(table), "hash", "left")
        .filter(F.when(F.col("template").isNull(), F.col("at") == 0).otherwise(same))
        .withColumn("diagonal", F.col("at") - 1 - F.col("tpos"))
        .groupBy("id", "text_hash", "n_words", "template", "label", "exact", "grams", "diagonal")
        .agg(F.bit_or(_power(F.col("tpos"))).alias("bits"),
             F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("copies"))
    )
    along = Window.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > slack), F.lit(True))
    spans = (
        votes.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(along))
        .groupBy("id", "text_hash", "n_words", "template", "label", "exact", "grams", "span")
        .agg(F.bit_or("bits").alias("bits"), F.min("start").alias("start"), F.max("end").alias("end"),
             F.max("copies").alias("copies"))
        .withColumn("share", F.bit_count("bits") / F.col("grams"))
    )
    long = F.col("end") - F.col("start") + 1 > 2 * F.col("grams")
    closed = F.col("bits").bitwiseAND(_power(F.col("grams") - 1)) != 0
    counts = F.when(F.col("exact"), F.col("share") == 1).otherwise((F.col("share") >= coverage) & closed & ~long)
    place = F.when(F.col("counts") & F.col("exact"), (F.col("start") - 1).cast("bigint"))
    found = spans.withColumn("counts", F.coalesce(counts, F.lit(False))).groupBy("id", "text_hash", "n_words").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        _labels(F.col("counts") & F.col("exact")).alias("base_labels"), _labels(F.col("counts")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("counts"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), "n_base", "first_word", "last_word",
        "base_labels", "labels", "score",
    )


def _power(bit: F.Column) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def _labels(which) -> F.Column:
    return F.concat_ws(",", F.array_sort(F.collect_set(F.when(which, F.col("label")))))
