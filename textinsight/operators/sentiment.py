"""Lexicon polarity and its three labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, words
from ..session import lookup_join

# Fixed values.
POSITIVE_ABOVE = 0.1
NEGATIVE_BELOW = -0.1
NEGATED = -0.5
# Polarity is rounded so that the order of a sum cannot flip a label.
POLARITY_DIGITS = 9

DEFAULT_NEGATORS = ("no", "not", "never", "without", "hardly")
# Our own short list on a scale of three steps each way. Pass a lexicon for real work.
_WORDS = {
    1.0: "amazing awesome best brilliant delightful excellent outstanding perfect superb wonderful",
    0.6: "beautiful easy enjoy friendly good great happy helpful impressive love nice pleasant reliable satisfied valuable",
    0.3: "better clear effective efficient fair fast fine fun glad interesting kind relevant right smooth strong useful",
    -0.3: "complicated difficult dull expensive hard lacking missing outdated slow tough unclear unsure",
    -0.6: "annoying bad boring broken confusing disappointed frustrating overwhelming pain poor sad unhappy useless worse wrong",
    -1.0: "awful disgusting dreadful horrible terrible worst",
}
# What a word right before does to the next polarity; our own few, as the list above.
DEFAULT_INTENSIFIERS = {"extremely": 1.5, "very": 1.3, "really": 1.3, "so": 1.2, "quite": 1.1, "rather": 0.9, "fairly": 0.9, "somewhat": 0.7, "slightly": 0.5}
# Share of an intensifier's effect that is left after a plain word between it and the polar one.
DAMPING = 0.5
DEFAULT_LEXICON = {word: score for score, words_ in _WORDS.items() for word in words_.split()}


def polarity(
    text: Column,
    lexicon: Mapping[str, float] = DEFAULT_LEXICON,
    negators: Sequence[str] = DEFAULT_NEGATORS,
    intensifiers: Mapping[str, float] | None = None,
    reach: int = 0,
) -> Column:
    """Mean polarity of the lexicon words of a text, 0.0 without any.

    A negator right before a word multiplies its polarity by -0.5. The whole
    computation stays in the row: no shuffle, and usable on a stream.

    With phrases in the lexicon (entries of several words), ``intensifiers`` or a ``reach``, the tokens
    are read from left to right. The longest entry that begins at a token counts and its words are passed
    over. Negators and intensifiers before it are in force: factors multiply, a negator gives -0.5, and the
    product stays within -1 and 1. Up to ``reach`` other words may stand between; each leaves
    ``DAMPING`` of what the intensifiers add or take. Another word more, or an entry, ends their force.
    """
    if intensifiers or reach or any(" " in entry for entry in lexicon):
        events = lambda tokens: _events(tokens, lexicon, negators, intensifiers or {})
        return F.round(bind(bind(words(text), events), lambda found: _read(found, reach)), POLARITY_DIGITS)
    known = list(lexicon)
    scores = F.create_map(*[F.lit(item) for pair in lexicon.items() for item in pair])

    def mean_of_hits(tokens: Column) -> Column:
        hits = F.array_compact(
            F.transform(
                tokens,
                # the hash test comes first; the map is searched for hits only
                lambda token, i: F.when(
                    token.isin(known),
                    F.element_at(scores, token)
                    * F.when(F.coalesce(F.get(tokens, i - 1).isin(list(negators)), F.lit(False)), NEGATED)
                    .otherwise(1.0),
                ),
            )
        )
        return bind(
            hits,
            lambda found: F.when(
                F.size(found) > 0,
                F.aggregate(found, F.lit(0.0), lambda total, score: total + score) / F.size(found),
            ).otherwise(0.0),
        )

    return F.round(bind(words(text), mean_of_hits), POLARITY_DIGITS)


def _value_of(token: Column, values: Mapping[str, float]) -> Column:
    """The value of a token, null for any other; the hash test comes first, the map is searched for hits only."""
    if not values:
        return F.lit(None).cast("double")
    table = F.create_map(*[F.lit(float(item) if isinstance(item, (int, float)) else item) for pair in values.items() for item in pair])
    return F.when(token.isin(list(values)), F.element_at(table, token))


def _events(tokens: Column, lexicon: Mapping[str, float], negators: Sequence[str], intensifiers: Mapping[str, float]) -> Column:
    """What each token begins or does: ``score`` and ``size`` of the longest entry, ``negates``, ``factor``.

    The entries are a prefix tree of two levels: the first word leads to the sizes of the entries that
    begin with it, and only then a run of that size is put together and looked up.
    """
    sizes: dict[int, dict[str, float]] = {}
    for entry, score in lexicon.items():
        sizes.setdefault(len(entry.split()), {})[" ".join(entry.split())] = score

    def event(token: Column, i: Column) -> Column:
        score, size = F.lit(None).cast("double"), F.lit(1)
        for n, entries in sorted(sizes.items()):  # the longest is tried first, so it is wrapped last
            if n == 1:
                found = _value_of(token, entries)
            else:
                run = F.array_join(F.slice(tokens, i + 1, n), " ")
                found = F.when(token.isin(sorted({e.split()[0] for e in entries})), _value_of(run, entries))
            score, size = F.coalesce(found, score), F.when(found.isNotNull(), F.lit(n)).otherwise(size)
        return F.struct(
            score.alias("score"), size.alias("size"), token.isin(list(negators)).alias("negates"),
            _value_of(token, intensifiers).alias("factor"))

    return F.transform(tokens, event)


def _read(events: Column, reach: int) -> Column:
    """Mean polarity by a left-to-right state over the events."""
    def state(skip, factor, sign, gap, total, n) -> Column:
        return F.struct(
            skip.cast("int").alias("skip"), factor.cast("double").alias("factor"), sign.cast("double").alias("sign"),
            gap.cast("int").alias("gap"), total.cast("double").alias("total"), n.cast("int").alias("n"))

    def step(s: Column, e: Column) -> Column:
        scored = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), e["score"] * s["factor"] * s["sign"]))
        one, none = F.lit(1.0), F.lit(0)
        return (
            F.when(s["skip"] > 0, state(s["skip"] - 1, s["factor"], s["sign"], s["gap"], s["total"], s["n"]))
            .when(e["score"].isNotNull(), state(e["size"] - 1, one, one, none, s["total"] + scored, s["n"] + 1))
            .when(e["negates"], state(none, s["factor"], F.lit(NEGATED), none, s["total"], s["n"]))
            .when(e["factor"].isNotNull(), state(none, s["factor"] * e["factor"], s["sign"], none, s["total"], s["n"]))
            .when(s["gap"] < reach, state(none, 1 + (s["factor"] - 1) * DAMPING, s["sign"], s["gap"] + 1, s["total"], s["n"]))
            .otherwise(state(none, one, one, none, s["total"], s["n"]))
        )

    start = state(F.lit(0), F.lit(1.0), F.lit(1.0), F.lit(0), F.lit(0.0), F.lit(0))
    return F.aggregate(events, start, step, lambda s: F.when(s["n"] > 0, s["total"] / s["n"]).otherwise(0.0))


def sentiment_label(score: Column) -> Column:
    """Positive above 0.1, Negative below -0.1, else Neutral; both bounds exclusive."""
    return (
        F.when(score > POSITIVE_ABOVE, "Positive").when(score < NEGATIVE_BELOW, "Negative").otherwise("Neutral")
    )


def with_sentiment(
    df: DataFrame,
    text_col: str = "response",
    lexicon: Mapping[str, float] = DEFAULT_LEXICON,
    negators: Sequence[str] = DEFAULT_NEGATORS,
    intensifiers: Mapping[str, float] | None = None,
    reach: int = 0,
) -> DataFrame:
    """Add ``polarity`` and ``sentiment``."""
    scored = df.withColumn("polarity", polarity(F.col(text_col), lexicon, negators, intensifiers, reach))
    return scored.withColumn("sentiment", sentiment_label(F.col("polarity")))


def polarity_from_tables(
    df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, negators: DataFrame
) -> DataFrame:
    """``(id, polarity)`` with the lexicon ``(word, polarity)`` and negators ``(word)`` as tables.

    Words are looked up by join, whatever the size of the tables. A word that is in the lexicon
    several times has the mean of its polarities. Rows of equal id stay rows of their own.
    """
    pairs = df.select(
        id_col,
        F.monotonically_increasing_id().alias("_row"),
        bind(
            words(F.col(text_col)),
            lambda tokens: F.transform(
                tokens, lambda token, i: F.struct(token.alias("word"), F.get(tokens, i - 1).alias("before"))
            ),
        ).alias("_pairs"),
    ).select(id_col, "_row", F.explode_outer("_pairs").alias("pair")).select(id_col, "_row", "pair.word", "pair.before")
    scores = lexicon.groupBy("word").agg(F.avg("polarity").alias("polarity"))
    flagged = negators.select(F.col("word").alias("before"), F.lit(True).alias("negated")).distinct()
    hits = lookup_join(pairs, scores, ["word"], "_row", "left")
    hits = lookup_join(hits, flagged, ["before"], "_row", "left")
    mean = F.avg(F.col("polarity") * F.when(F.col("negated"), NEGATED).otherwise(1.0))
    return hits.groupBy("_row", id_col).agg(
        F.round(F.coalesce(mean, F.lit(0.0)), POLARITY_DIGITS).alias("polarity")
    ).drop("_row")


def apply_text_fn(
    df: DataFrame, fn: Callable[[str], object], text_col: str, out_col: str, return_type: str = "string"
) -> DataFrame:
    """A Python function applied to each value of a column, in Arrow batches."""

    @F.pandas_udf(return_type)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore")

    return df.withColumn(out_col, apply(F.col(text_col)))
