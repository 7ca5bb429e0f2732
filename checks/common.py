"""Inputs and SQL fragments shared by the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textinsight.functions.text import LINE_BREAK, NON_ASCII, WHITESPACE
from textinsight.session import shared_folder
from textinsight.sources.tables import read_table

STOP_WORDS = ["the", "of", "and", "la", "de", "der"]
LEXICON = {"for": 0.5, "was": -0.6, "it": 0.2, "der": -0.3, "la": 0.4}
NEGATORS = ["of", "is"]
PHRASES = {"for": 0.5, "was": -0.6, "it": 0.2, "la": 0.4, "the and": -0.4, "in that": 0.9, "it is of": -0.8, "de les": 0.7, "des": -0.9}
INTENSIFIERS = {"to": 1.5, "in": 0.6, "der": 1.25, "et": 2.0}
SURVEY = "Member survey"
QUESTION = "What could we do better?"
KEYWORD_TOP = 15


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has written to."""
    return f"{shared_folder(spark)}/check-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents", "doc_id")


def in_list(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WHITESPACE}]+|[{WHITESPACE}]+$', '', 'g')"


def sql_unescape(expr: str) -> str:
    """The entities the pages have; the ampersand goes last."""
    for entity, char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        expr = f"replace({expr}, '&{entity};', '{char}')"
    return expr


def sql_ascii_clean(expr: str) -> str:
    return f"regexp_replace({expr}, '{NON_ASCII}', '-', 'g')"


SQL_LINES = (
    "SELECT doc_id, unnest(string_split_regex(text, '" + LINE_BREAK + "')) AS line, "
    "generate_subscripts(string_split_regex(text, '" + LINE_BREAK + "'), 1) - 1 AS line_no FROM documents"
)
SQL_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SQL_TERMS = (
    r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), "
    f"lambda t: t NOT IN ({in_list(STOP_WORDS)}))"
)
SQL_BIGRAMS = (
    f"list_transform(list_zip({SQL_TERMS}, ({SQL_TERMS})[2:], true), lambda z: z[1] || ' ' || z[2])"
)
SQL_NGRAMS = f"list_concat({SQL_TERMS}, {SQL_BIGRAMS})"

# CTEs up to x(doc_id, term, tf, weight): TF-IDF rows of norm 1 over all documents.
SQL_TFIDF = f"""
tf AS (SELECT doc_id, term, count(*) AS tf
       FROM (SELECT doc_id, unnest({SQL_TERMS}) AS term FROM documents) GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, term, tf, tf * (ln((1 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN d USING (term), n),
x AS (SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""

# CTEs up to gx(lang, doc_id, term, tf, weight): the same inside each language, capped.
SQL_GROUP_VOCABULARY = f"""
gtf AS (SELECT lang, doc_id, term, count(*) AS tf
        FROM (SELECT lang, doc_id, unnest({SQL_NGRAMS}) AS term FROM documents) GROUP BY 1, 2, 3),
gtotals AS (SELECT lang, term, sum(tf) AS n, count(*) AS df FROM gtf GROUP BY 1, 2),
gd AS (SELECT * FROM gtotals
       QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 100)"""
SQL_GROUP_TFIDF = f"""{SQL_GROUP_VOCABULARY},
gn AS (SELECT lang, count(*) AS docs FROM documents GROUP BY 1),
gw AS (SELECT lang, doc_id, term, tf, tf * (ln((1 + docs) / (1.0 + df)) + 1) AS w
       FROM gtf JOIN gd USING (lang, term) JOIN gn USING (lang)),
gx AS (SELECT lang, doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY lang, doc_id)) AS weight FROM gw)"""
SQL_KEYWORDS = f"""{SQL_GROUP_TFIDF},
scores AS (SELECT lang, term, round(sum(weight), 9) AS score FROM gx GROUP BY 1, 2),
kw AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank, term, score
       FROM scores QUALIFY rank <= {KEYWORD_TOP})"""

# Replies of six kinds, made from the documents; see replies() for the Spark side.
REPLY_TITLE = "Theme "
SQL_REPLIES = """
SELECT doc_id AS cluster, CASE doc_id % 6
  WHEN 0 THEN j
  WHEN 1 THEN '```json' || chr(10) || j || chr(10) || '```'
  WHEN 2 THEN '```' || chr(10) || j || chr(10) || '```'
  WHEN 3 THEN 'Sorry: ' || source
  WHEN 4 THEN '  {"title": "Theme ' || source || '", "actions": ["act on ' || lang || '"]}'
  ELSE j || ' trailing text' END AS reply
FROM (SELECT doc_id, source, lang,
        '{"title": "Theme ' || source || '", "insight": "Insight ' || lang || '", "actions": ["one ' || n_chars || '", "two"]}' AS j
      FROM documents)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = documents(spark, sf_dir)
    full = F.concat(
        F.lit('{"title": "Theme '), "source", F.lit('", "insight": "Insight '), "lang",
        F.lit('", "actions": ["one '), F.col("n_chars").cast("string"), F.lit('", "two"]}'),
    )
    kind = F.col("doc_id") % 6
    partial = F.concat(F.lit('  {"title": "Theme '), "source", F.lit('", "actions": ["act on '), "lang", F.lit('"]}'))
    reply = (
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("```\n"), full, F.lit("\n```")))
        .when(kind == 3, F.concat(F.lit("Sorry: "), "source"))
        .when(kind == 4, partial)
        .otherwise(F.concat(full, F.lit(" trailing text")))
    )
    return doc.select(F.col("doc_id").alias("cluster"), reply.alias("reply"))


# Expected parse of SQL_REPLIES.
SQL_PARSED = """
SELECT doc_id AS cluster,
  CASE WHEN doc_id % 6 IN (0, 1, 4) THEN 'Theme ' || source
       ELSE 'Cluster ' || doc_id || ' - Undefined' END AS title,
  CASE WHEN doc_id % 6 IN (0, 1) THEN 'Insight ' || lang
       ELSE 'Insight could not be generated.' END AS insight,
  CASE WHEN doc_id % 6 IN (0, 1) THEN ['one ' || n_chars, 'two']
       WHEN doc_id % 6 = 4 THEN ['act on ' || lang]
       ELSE ['No actions available due to error.'] END AS actions
FROM documents"""


# --- pages --------------------------------------------------------------------------------------
# Sites of 20 pages each. Page j links to 2j+1, 2j+2 and j+3 of its site, to another site, to its
# root, to itself with a fragment and to a mail address. Targets above the last page of a site are
# failed fetches, and so are the links the page had before.
SITE_PAGES = 20
MAX_PAGES = 5
MAX_DEPTH = 2
# A seed without a page.
NOWHERE = "http://nowhere.example/p0"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "pages", "page_id")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts])


def described_html(page_id: Column, html: Column) -> Column:
    """Pages with a description and structured data put into the head or the body."""
    meta = (
        F.when(page_id % 3 == 0, _text('<meta name="description" content="  About page ', page_id, ' &amp; more ">'))
        .when(page_id % 3 == 1, _text("<META content='Page ", page_id, "' NAME='description'/>"))
        .otherwise("")
    )
    script = '<script type="application/ld+json">'
    good = _text(script, '{"@type": "WebPage", "id": ', page_id, ', "tags": ["a", "b"]}</script>')
    head = F.when(page_id % 4 == 0, good).when(page_id % 4 == 1, _text(script, "{broken</script>")).otherwise("")
    with_head = F.replace(html, F.lit("</head>"), F.concat(meta, head, F.lit("</head>")))
    body = F.when(page_id % 4 == 2, good).otherwise("")
    return F.replace(with_head, F.lit("</nav>"), F.concat(body, F.lit("</nav>")))


def described_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir)
    return rows.withColumn("html", described_html(F.col("page_id"), F.col("html")))


def site_url(page_id: Column) -> Column:
    return _text("http://s", F.floor(page_id / SITE_PAGES), ".example/p", page_id % SITE_PAGES)


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    j, site = page % SITE_PAGES, F.floor(page / SITE_PAGES)
    anchors = _text(
        '<a href="p', 2 * j + 1, '">a</a><a class=x href=\'/p', 2 * j + 2, "'>b</a><A HREF=//s", site, ".example/p",
        j + 3, '>c</A><a href="http://s', site + 1, '.example/p0">d</a><a href="./x/../p0">e</a>'
        '<a href="#missing">f</a><a href="mailto:x@s.example">g</a><a name="h">h</a>',
    )
    html = F.replace(described_html(page, F.col("html")), F.lit("</nav>"), F.concat(anchors, F.lit("</nav>")))
    return pages(spark, sf_dir).select("page_id", site_url(page).alias("url"), html.alias("html"))


def seeds(linked: DataFrame) -> DataFrame:
    return linked.filter(F.col("page_id") % SITE_PAGES == 0).select(F.col("url").alias("seed"))


SQL_DESCRIBED = """
SELECT page_id, url, replace(replace(html, '</head>',
  CASE page_id % 3 WHEN 0 THEN '<meta name="description" content="  About page ' || page_id || ' &amp; more ">'
                   WHEN 1 THEN '<META content=''Page ' || page_id || ''' NAME=''description''/>' ELSE '' END ||
  CASE page_id % 4 WHEN 0 THEN '<script type="application/ld+json">' || good || '</script>'
                   WHEN 1 THEN '<script type="application/ld+json">{broken</script>' ELSE '' END || '</head>'),
  '</nav>', CASE page_id % 4 WHEN 2 THEN '<script type="application/ld+json">' || good || '</script>' ELSE '' END || '</nav>') AS html
FROM (SELECT *, '{"@type": "WebPage", "id": ' || page_id || ', "tags": ["a", "b"]}' AS good FROM pages)"""

SQL_CLEAN = (
    "regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', chr(1), 'g')"
)
SQL_TITLE = sql_strip(sql_unescape("regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)"))
SQL_H1 = (
    "list_transform(regexp_extract_all(" + SQL_CLEAN + ", '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda h: "
    "array_to_string(list_transform(string_split_regex(h, '<[^>]*>|\\x01'), lambda s: "
    + sql_strip(sql_unescape("s")) + "), ''))"
)


def sql_body_text(extra: str = "") -> str:
    """Text nodes of the body, one per line; ``extra`` is markup added at the end of the menu."""
    html = f"replace({SQL_CLEAN}, '</nav>', '{extra}</nav>')" if extra else SQL_CLEAN
    body = f"split_part(regexp_replace({html}, '(?is)^.*?<body[^>]*>', ''), '</body>', 1)"
    return (
        f"array_to_string(list_filter(list_transform(string_split_regex({body}, '<[^>]*>|\\x01'), "
        f"lambda s: {sql_strip(sql_unescape('s'))}), lambda s: s <> ''), chr(10))"
    )


# CTEs up to walk(site, ord, depth, j): shortest paths first, link positions break ties.
SQL_WALK = f"""
RECURSIVE p AS (SELECT page_id, page_id // {SITE_PAGES} AS site, page_id % {SITE_PAGES} AS j FROM pages),
e AS (SELECT p.site, p.j, t.pos, t.dst
      FROM p, LATERAL (VALUES (0, 2 * p.j + 1), (1, 2 * p.j + 2), (2, p.j + 3), (3, 0)) AS t(pos, dst)
      JOIN p AS q ON q.site = p.site AND q.j = t.dst),
w AS (SELECT site, j, 0 AS depth, '' AS path FROM p WHERE j = 0
      UNION ALL
      SELECT w.site, e.dst, w.depth + 1, w.path || e.pos FROM w JOIN e ON e.site = w.site AND e.j = w.j
      WHERE w.depth < {MAX_DEPTH}),
firsts AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY site, j ORDER BY depth, path) = 1),
walk AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY depth, path) AS ord, depth, j
         FROM firsts QUALIFY ord <= {MAX_PAGES})"""

# CTEs up to prof(site, title, meta_description, h1, text, structured_data): merged page fields.
SQL_PROFILE = f"""{SQL_WALK},
f AS (SELECT walk.site, walk.ord, d.page_id, {SQL_TITLE} AS title,
        CASE d.page_id % 3 WHEN 0 THEN 'About page ' || d.page_id || ' & more'
                           WHEN 1 THEN 'Page ' || d.page_id ELSE '' END AS meta_description,
        {SQL_H1} AS h1,
        {sql_body_text('<a>a</a><a>b</a><a>c</a><a>d</a><a>e</a><a>f</a><a>g</a><a>h</a>')} || chr(10) AS text,
        CASE d.page_id % 4 WHEN 0 THEN ['{{"@type":"WebPage","id":' || d.page_id || ',"tags":["a","b"]}}']
                           ELSE CAST([] AS VARCHAR[]) END AS structured_data
      FROM walk JOIN pages AS d ON d.page_id = walk.site * {SITE_PAGES} + walk.j),
prof AS (SELECT site, 'http://s' || site || '.example/p0' AS seed,
           coalesce(min_by(title, ord) FILTER (WHERE title <> ''), '') AS title,
           coalesce(min_by(meta_description, ord) FILTER (WHERE meta_description <> ''), '') AS meta_description,
           flatten(list(h1 ORDER BY ord)) AS h1,
           string_agg(text, '' ORDER BY ord) AS text,
           flatten(list(structured_data ORDER BY ord)) AS structured_data
         FROM f GROUP BY site)"""
