"""String expressions: stripping, tokens, n-grams, term counts, report text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. White space and line breaks as Python's str.strip and
# str.splitlines see them, word characters as Python's \w sees them.
WHITESPACE = r"\t-\r\x1c- \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITESPACE_CHARS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]"
NON_ASCII = r"[^\x00-\x7F]+"
FENCE_JSON = "```json"
FENCE = "```"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Spark evaluates lambdas of higher-order functions row by row without common
    subexpression elimination, so an expression used inside one is bound first.
    """
    return F.get(F.transform(F.array(value), body), 0)


def exploded(df: DataFrame, keys: Sequence[str], values: Column, name: str) -> DataFrame:
    """``(keys..., name)``: one row per element that is not null.

    Spark puts a filter on the size of the array below a plain ``explode``, and so works an expression out twice.
    """
    return df.select(*keys, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def words(text: Column, min_chars: int = 1) -> Column:
    """Lower-cased word runs of at least ``min_chars`` characters, in text order."""
    run = WORD + ("+" if min_chars == 1 else "{%d,}" % min_chars)
    return F.regexp_extract_all(F.lower(text), F.lit(run), F.lit(0))


def without(tokens: Column, dropped: Sequence[str]) -> Column:
    """Drop every token that is in ``dropped`` (a hash look-up per token)."""
    if not dropped:
        return tokens
    return F.filter(tokens, lambda token: ~token.isin(list(dropped)))


def terms(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Vectoriser tokens: words of two or more characters minus stop words."""
    return without(words(text, 2), stop_words)


def bigrams(tokens: Column, followers: Column | None = None) -> Column:
    """Each token joined by one space with the next of ``followers`` (by default ``tokens``)."""
    followers = tokens if followers is None else followers
    return F.when(
        F.size(tokens) > 1,
        F.zip_with(
            F.slice(tokens, F.lit(1), F.size(tokens) - 1),
            F.slice(followers, F.lit(2), F.size(followers) - 1),
            lambda first, second: F.concat(first, F.lit(" "), second),
        ),
    ).otherwise(F.array().cast("array<string>"))


def unigrams_and_bigrams(tokens: Column) -> Column:
    return bind(tokens, lambda seq: F.concat(seq, bigrams(seq)))


def _runs(ordered: Column, key: Callable[[Column], Column], entry: Callable[[Column, Column], Column]) -> Column:
    """One ``entry(first item, length)`` per run of equal keys of a sorted array."""
    starts = F.array_compact(
        F.transform(
            ordered,
            lambda item, i: F.when((i == 0) | (key(item) != key(F.get(ordered, i - 1))), i),
        )
    )
    return bind(
        starts,
        lambda start: F.transform(
            start,
            lambda at, i: entry(
                F.get(ordered, at),
                (F.coalesce(F.get(start, i + 1), F.size(ordered)) - at).cast("bigint"),
            ),
        ),
    )


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one row, by run length over the sorted tokens.

    A document is one row, so its counts need no shuffle.
    """
    return bind(
        F.sort_array(tokens),
        lambda ordered: _runs(
            ordered, lambda term: term, lambda term, n: F.struct(term.alias("term"), n.alias("tf"))
        ),
    )


def keyword_counts(
    text: Column, min_chars: int = 4, skip_prefixes: Sequence[str] = ("http", "www")
) -> Column:
    """``array<struct<word, n, pos>>`` of the keywords of one text; ``pos`` is the first position."""
    placed = F.transform(words(text), lambda word, i: F.struct(word.alias("word"), i.alias("pos")))
    kept = F.filter(placed, lambda item: keep_keyword(item["word"], min_chars, skip_prefixes))
    return bind(
        F.sort_array(kept),
        lambda ordered: _runs(
            ordered,
            lambda item: item["word"],
            lambda item, n: F.struct(item["word"].alias("word"), n.alias("n"), item["pos"].alias("pos")),
        ),
    )


def top_keywords(text: Column, min_chars: int = 4, top_n: int = 20) -> Column:
    """The most frequent keywords of one text, ties in first-seen order."""
    ranked = F.sort_array(
        F.transform(
            keyword_counts(text, min_chars),
            lambda item: F.struct((-item["n"]).alias("n"), item["pos"].alias("pos"), item["word"].alias("word")),
        )
    )
    return F.transform(F.slice(ranked, 1, top_n), lambda item: item["word"])


def starts_with_any(word: Column, prefixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | word.startswith(prefix)
    return found


def keep_keyword(word: Column, min_chars: int = 4, skip_prefixes: Sequence[str] = ("http", "www")) -> Column:
    """The site keyword test: long enough and not the start of a link."""
    return (F.length(word) >= min_chars) & ~starts_with_any(word, skip_prefixes)


def truncate(text: Column, max_chars: int = 5000) -> Column:
    """The first ``max_chars`` characters followed by an ellipsis."""
    return F.concat(F.substring(text, 1, max_chars), F.lit("..."))


def ascii_clean(text: Column) -> Column:
    """Each run of non-ASCII characters becomes one dash."""
    return F.regexp_replace(text, NON_ASCII, "-")


def strip_json_fence(reply: Column) -> Column:
    """Unwrap a reply that starts with a json code fence; strip any reply."""
    bare = strip(reply)
    unfenced = strip(F.replace(F.replace(bare, F.lit(FENCE_JSON), F.lit("")), F.lit(FENCE), F.lit("")))
    return F.when(bare.startswith(FENCE_JSON), unfenced).otherwise(bare)


def cluster_title(cluster: Column, title: Column) -> Column:
    return F.concat(F.lit("Cluster "), cluster.cast("string"), F.lit(" - "), title)


def bullet_join(items: Column) -> Column:
    return F.concat(F.lit("- "), F.array_join(items, "\n- "))


def keyword_line(keywords: Column) -> Column:
    """Comma-joined keyword terms, or null when there are none."""
    names = F.array_join(F.transform(keywords, lambda keyword: keyword["term"]), ", ")
    return F.when(F.size(keywords) > 0, F.concat(F.lit("Top Keywords: "), names))
