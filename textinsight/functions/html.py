"""HTML field expressions over a raw page string.

All of them start from ``visible_markup``: one left-to-right pass that replaces
comments, scripts and styles by a mark, so that later patterns cannot match
inside them. Every pattern is linear in the page and keeps to the JVM.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, WHITESPACE_CHARS, bind, strip

# A Unicode noncharacter, so it cannot be page text.
MARK = "\ufdd0"
# Possessive, so that Java's matcher loops instead of recursing on long tags.
ATTRIBUTES = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
TAG = rf"</?[A-Za-z]{ATTRIBUTES}>|</?[A-Za-z][^>]*>"
COMMENT = r"<!--.*?(?:-->|\z)|<![A-Za-z][^>]*>|<\?[^>]*>"
SCRIPT = rf"<script\b{ATTRIBUTES}>.*?(?:</script[^>]*>|\z)"
STYLE = rf"<style\b{ATTRIBUTES}>.*?(?:</style[^>]*>|\z)"
HIDDEN = rf"(?is){COMMENT}|{SCRIPT}|{STYLE}"
EMBEDDED = (
    rf"(?is)<noscript\b{ATTRIBUTES}>.*?(?:</noscript[^>]*>|\z)"
    rf"|<iframe\b{ATTRIBUTES}>.*?(?:</iframe[^>]*>|\z)"
)
BODY_OPEN = rf"(?is)<body(?:\s{ATTRIBUTES})?>"
BODY_CLOSE = r"(?i)</body\s*>"
ATTRIBUTE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""

# Windows-1252 meanings of the numeric references 128 to 159.
CP1252 = {
    str(code): char
    for code in range(128, 160)
    if (char := bytes([code]).decode("cp1252", "ignore"))
}
# Entities that make up nearly all real text come first, as a map is searched in order.
FREQUENT = ("amp;", "nbsp;", "quot;", "lt;", "gt;", "apos;", "copy;", "middot;", "hellip;", "mdash;",
            "ndash;", "lsquo;", "rsquo;", "ldquo;", "rdquo;", "reg;", "trade;", "euro;")
NAMED = {name: html5[name] for name in FREQUENT} | html5


def _literal_map(pairs: dict[str, str]) -> Column:
    # One foldable literal instead of a call into the JVM per entry.
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _code_point(number: Column) -> Column:
    """The character of a decimal code point string."""
    code = number.try_cast("bigint")
    usable = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(usable, code)), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(_literal_map(CP1252), number), char, F.lit("\ufffd"))


def _meaning(reference: Column) -> Column:
    """Characters of a reference such as ``amp;``, ``#39;`` or ``#x27``; null when unknown."""
    hexadecimal = F.conv(F.regexp_extract(reference, r"^#[xX]([0-9A-Fa-f]+)", 1), 16, 10)
    decimal = F.regexp_replace(reference, "^#0*|;", "")
    number = F.when(reference.rlike("^#[xX]"), hexadecimal).otherwise(decimal)
    return (
        F.when(reference == "", F.lit(None))
        .when(reference.startswith("#"), bind(number, _code_point))
        .otherwise(F.try_element_at(_literal_map(NAMED), reference))
    )


def _replace_reference(piece: Column) -> Column:
    """``piece`` is what followed an ampersand."""
    reference = F.regexp_extract(piece, r"^(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)", 1)

    def decoded(found: Column) -> Column:
        return bind(
            _meaning(found),
            lambda char: F.when(
                char.isNotNull(), F.concat(char, F.substr(piece, F.length(found) + 1))
            ).otherwise(F.concat(F.lit("&"), piece)),
        )

    return bind(reference, decoded)


def unescape(text: Column) -> Column:
    """Decode named and numeric character references in one pass."""

    def decode(pieces: Column) -> Column:
        return F.array_join(
            F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(_replace_reference(piece))), ""
        )

    return bind(
        text, lambda raw: F.when(F.instr(raw, "&") > 0, bind(F.split(raw, "&"), decode)).otherwise(raw)
    )


def visible_markup(html: Column) -> Column:
    """The page with comments, scripts, styles and declarations cut out."""
    return F.regexp_replace(html, HIDDEN, MARK)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag (the last one wins), null when absent."""
    inner = F.regexp_replace(tag, r"^<[A-Za-z][A-Za-z0-9:\-]*|/?>\z", "")
    found = F.filter(
        F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(0)),
        lambda pair: pair.rlike(rf"(?is)^{name}\s*(?:=|\z)"),
    )
    raw = F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"(?s)^[^=]*(?:=\s*|\z)", "")
    unquoted = bind(
        raw,
        lambda value: F.when(
            value.rlike(r"""^["']"""), F.substr(value, F.lit(2), F.length(value) - 2)
        ).otherwise(value),
    )
    return unescape(unquoted)


def _text_nodes(markup: Column, separator: str) -> Column:
    """Text nodes stripped, blank ones dropped, joined by ``separator``."""
    marked = unescape(F.regexp_replace(markup, rf"(?is){TAG}", MARK))
    joined = F.regexp_replace(marked, rf"[{WHITESPACE}]*{MARK}[{WHITESPACE}{MARK}]*", MARK)
    trimmed = F.btrim(joined, F.lit(WHITESPACE_CHARS + MARK))
    return F.replace(trimmed, F.lit(MARK), F.lit(separator))


def links(markup: Column) -> Column:
    """``href`` of every anchor that has one, in document order."""
    anchors = F.regexp_extract_all(markup, F.lit(rf"(?is)<a\s{ATTRIBUTES}>"), F.lit(0))
    return F.filter(
        F.transform(anchors, lambda anchor: attribute(anchor, "href")), lambda href: href.isNotNull()
    )


def title(markup: Column) -> Column:
    """Stripped text of the first title; empty when it has child nodes or is absent."""
    inner = F.regexp_extract(markup, rf"(?is)<title(?:\s{ATTRIBUTES})?>(.*?)(?:</title\s*>|\z)", 1)
    return bind(
        inner,
        lambda content: F.when(
            content.contains(MARK) | content.rlike(rf"(?is){TAG}"), ""
        ).otherwise(strip(unescape(content))),
    )


def meta_description(markup: Column) -> Column:
    """Stripped ``content`` of the first description meta tag; empty when absent."""
    metas = F.regexp_extract_all(markup, F.lit(rf"(?is)<meta\s{ATTRIBUTES}>"), F.lit(0))
    described = F.filter(metas, lambda meta: attribute(meta, "name") == "description")
    content = bind(F.get(described, 0), lambda meta: attribute(meta, "content"))
    return F.coalesce(strip(content), F.lit(""))


def h1_texts(markup: Column) -> Column:
    """Text of every h1, inner tags removed."""
    found = F.regexp_extract_all(
        markup, F.lit(rf"(?is)<h1(?:\s{ATTRIBUTES})?>(.*?)(?:</h1\s*>|</body\s*>|\z)"), F.lit(1)
    )
    return F.transform(found, lambda inner: _text_nodes(inner, ""))


def body_text(markup: Column) -> Column:
    """Visible text of the body, one text node per line; null when there is no body."""

    def within(parts: Column) -> Column:
        body = F.get(F.split(F.get(parts, 1), BODY_CLOSE, 2), 0)
        return F.when(
            F.size(parts) > 1, _text_nodes(F.regexp_replace(body, EMBEDDED, MARK), "\n")
        )

    return bind(F.split(markup, BODY_OPEN, 2), within)


def json_ld(html: Column) -> Column:
    """Source text of each JSON-LD script outside the body, in order.

    Body scripts are dropped before structured data is looked for, so only
    those before the body opens or after it closes count.
    """
    pieces = rf"(?is){COMMENT}|{SCRIPT}|{STYLE}|<body(?:\s{ATTRIBUTES})?>|</body\s*>"

    def outside(tokens: Column) -> Column:
        def at(pattern: str) -> Column:
            return F.array_min(
                F.filter(
                    F.transform(tokens, lambda token, i: F.when(token.rlike(pattern), i)),
                    lambda i: i.isNotNull(),
                )
            )

        opened, closed = at(r"(?i)^<body\b"), at(r"(?i)^</body\b")
        return bind(
            F.struct(opened.alias("opened"), closed.alias("closed")),
            lambda span: F.filter(
                tokens,
                lambda token, i: token.rlike(r"(?i)^<script\b")
                & ~(F.coalesce(i > span["opened"], F.lit(False)) & F.coalesce(i < span["closed"], F.lit(True))),
            ),
        )

    scripts = bind(F.regexp_extract_all(html, F.lit(pieces), F.lit(0)), outside)
    typed = F.filter(
        scripts,
        lambda script: F.coalesce(
            attribute(F.regexp_extract(script, rf"(?is)^<script\b{ATTRIBUTES}>", 0), "type")
            == "application/ld+json",
            F.lit(False),
        ),
    )
    return F.transform(
        typed,
        lambda script: F.regexp_replace(script, rf"(?is)^<script\b{ATTRIBUTES}>|</script[^>]*>\z", ""),
    )


def valid_json(documents: Column) -> Column:
    """Keep the documents that parse, as compact JSON text, keys in their order and repeated ones kept.

    A document is parsed as the only element of an array and as the only field of an object: text
    after a valid value may close one of them, never both. NaN and infinities pass.
    """
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}

    def parsed(text: Column) -> Column:
        element = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", options)
        field = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string", options)
        return F.when(text.rlike(r"^\s*null\s*$"), "null").when(
            (F.size(element) == 1) & field["v"].isNotNull(), F.get(element, 0))

    return F.array_compact(F.transform(documents, parsed))
