import html
import json
import random
import re
from collections import Counter
from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textinsight.functions import html as H
from textinsight.functions import text as T
from textinsight.functions import urls as U
from textinsight.functions.replies import parse_insight

TEXTS = [
    "", " ", "x", ".", "The cat, the CAT and a dog_1", "naïve café — déjà vu", "It’s “good”",
    "one two three", "　pad　", "tab\there", "emoji 🙂 ok", "a-b c2 _x", "Straße ÉTÉ", "١٢٣ ok",
]


def column(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, c string")
    return [row["v"] for row in rows.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]


def test_strip_and_words_follow_python(spark):
    assert column(spark, TEXTS, T.strip) == [text.strip() for text in TEXTS]
    assert column(spark, TEXTS, T.words) == [re.findall(r"\b\w+\b", text.lower()) for text in TEXTS]
    assert column(spark, TEXTS, T.terms) == [re.findall(r"\b\w\w+\b", text.lower()) for text in TEXTS]
    assert column(spark, TEXTS, T.ascii_clean) == [re.sub(r"[^\x00-\x7F]+", "-", text) for text in TEXTS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["ab", "cd", "ef", "the", "gh"]), max_size=9), min_size=1, max_size=20))
def test_counts_and_bigrams(spark, docs):
    texts = [" ".join(doc) for doc in docs]
    kept = [[token for token in doc if token != "the"] for doc in docs]
    pairs = [doc + [f"{a} {b}" for a, b in zip(doc, doc[1:])] for doc in kept]
    grams = column(spark, texts, lambda c: T.unigrams_and_bigrams(T.terms(c, ["the"])))
    assert grams == pairs
    counted = column(spark, texts, lambda c: T.term_counts(T.unigrams_and_bigrams(T.terms(c, ["the"]))))
    assert [{item["term"]: item["tf"] for item in row} for row in counted] == [dict(Counter(doc)) for doc in pairs]
    assert all([item["term"] for item in row] == sorted(item["term"] for item in row) for row in counted)


def test_top_keywords_ties_in_first_seen_order(spark):
    text = "zeta alpha zeta https wwwx beta alpha cat gamma"
    assert column(spark, [text, ""], lambda c: T.top_keywords(c, 4, 3)) == [["zeta", "alpha", "beta"], []]


def test_fences(spark):
    replies = ['```json\n{"a": 1}\n```', '  ```json {"a":1}```  ', '```\n{"a": 1}\n```', "plain ", ""]

    def expected(reply):
        reply = reply.strip()
        return reply.replace("```json", "").replace("```", "").strip() if reply.startswith("```json") else reply

    assert column(spark, replies, T.strip_json_fence) == [expected(reply) for reply in replies]


@pytest.mark.parametrize(
    "reply, title, actions",
    [
        ('{"title": "T", "insight": "I", "actions": ["a", "b"]}', "T", ["a", "b"]),
        ('```json\n{"title": "T", "insight": "I", "actions": ["a"]}\n```', "T", ["a"]),
        ('{"title": 5, "insight": "I", "actions": ["a"]}', "5", ["a"]),
        ('{"title": "T", "insight": "I"}', "T", ["No actions available due to error."]),
        ('{"title": "T", "actions": "a"}', "T", ["No actions available due to error."]),
        ('{"title": "T"} and more', "Cluster 7 - Undefined", ["No actions available due to error."]),
        ('{"title": "T"},{"title": "U"}', "Cluster 7 - Undefined", ["No actions available due to error."]),
        ('[{"title": "T"}]', "Cluster 7 - Undefined", ["No actions available due to error."]),
        ("[]", "Cluster 7 - Undefined", ["No actions available due to error."]),
        ("null", "Cluster 7 - Undefined", ["No actions available due to error."]),
        ("", "Cluster 7 - Undefined", ["No actions available due to error."]),
        (None, "Cluster 7 - Undefined", ["No actions available due to error."]),
    ],
)
def test_parse_insight(spark, reply, title, actions):
    (parsed,) = column(spark, [reply], lambda c: parse_insight(F.lit(7), c))
    assert (parsed["title"], parsed["actions"]) == (title, actions)


BASES = ["http://a.example/b/c/d;p?q", "https://a.example", "http://a.example/", "http://u@a.example:81/x/?y#z",
         "http://a.example/x//y/z", "HTTP://A.example/Q"]
REFERENCES = ["", "g", "./g", "g/", "/g", "//h.example", "//h.example/x?y#z", "?y", "g?y", "#s", "g#s", "g?y#s", ";x",
              "g;x", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..",
              "./../g", "./g/.", "g/./h", "g/../h", "http:g", "http://x.example", "https://x.example/p", "mailto:a@b",
              "javascript:void(0)", "//h.example?", "a//b", "/a//b", "a b", " /lead", "g?y/../x", "x#a#b", "tel:+1"]


def test_url_join_follows_the_standard_library(spark):
    pairs = [(base, ref) for base in BASES for ref in REFERENCES]
    rows = spark.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "i long, b string, r string")
    got = [row["v"] for row in rows.select("i", U.url_join(F.col("b"), F.col("r")).alias("v")).orderBy("i").collect()]
    wrong = [(pair, urljoin(*pair), value) for pair, value in zip(pairs, got) if urljoin(*pair) != value]
    assert wrong == []


def test_netloc_never_fails(spark):
    urls = ["http://a.b/c", "//x:8/y", "mailto:a@b", "/p", "", "http://u:p@h:1?q", "http://bad host/x", "HTTPS://Up/"]
    assert column(spark, urls, U.netloc) == [urlparse(url).netloc for url in urls]


def test_unescape_follows_the_standard_library(spark):
    texts = ["a &amp; b", "&amp;quot;", "&#39;&#x27;&#X41;", "&copy 2020", "&nosuch; &", "&#150;", "&hellip;&eacute;&NotEqualTilde;",
             "&#x1F600;", "&&amp;&", "no", "&lt;b&gt;", "&#0;", "&#xD800;", "&amp"]
    assert column(spark, texts, H.unescape) == [html.unescape(text) for text in texts]


PAGE = """<!DOCTYPE html><HTML><head><!-- <title>no</title> --><script>var a="<title>x</title>";</script>
<TITLE lang="en"> First &amp; best </TITLE><title>second</title>
<meta charset=utf-8><meta data-name='description' content="wrong"><meta content='It&#39;s > good' name="description" />
<script type="application/ld+json">{"a": [1, 2.50], "b": "<body>"}</script>
<script type='application/ld+json'>{bad</script><script type=application/ld+json>null</script></head>
<body class="x>y"><h1> One <b>two </b><i></i></h1><p>text<!-- c -->split&nbsp;<img src=a.png>end</p>
<script type="application/ld+json">{"inside": 1}</script><noscript>hidden</noscript><iframe src=q>frame</iframe>
<style>p { color: red }</style><A title="a>b" HREF='/up'>up</A><a name=x>none</a><a href="">self</a><a href=?q=1&amp;r=2>q</a>
<h1>Second</h1><br>tail</body><script type="application/ld+json">{"after": true}</script></html>"""


def test_page_fields(spark):
    (got,) = column(
        spark, [PAGE],
        lambda c: T.bind(H.visible_markup(c), lambda m: F.struct(
            H.title(m).alias("title"), H.meta_description(m).alias("meta"), H.h1_texts(m).alias("h1"),
            H.body_text(m).alias("text"), H.links(m).alias("links"),
            H.valid_json(H.json_ld(c)).alias("data"))),
    )
    assert got["title"] == "First & best"
    assert got["meta"] == "It's > good"
    assert got["h1"] == ["Onetwo", "Second"]
    assert got["text"].split("\n") == ["One", "two", "text", "split", "end", "up", "none", "self", "q", "Second", "tail"]
    assert got["links"] == ["/up", "", "?q=1&r=2"]
    assert got["data"] == ['{"a":[1,2.5],"b":"<body>"}', "null", '{"after":true}']


@pytest.mark.parametrize(
    "page, title, text",
    [
        ("<title>a<b>c</b></title><title>d</title>", "", None),
        ("<p>no body</p>", "", None),
        ("<body>open <b>bold", "", "open\nbold"),
        ("<body></body>", "", ""),
        ("<title> </title><body>x<script>var t='</p>'", "", "x"),
        ("<BODY>a</BODY> tail", "", "a"),
        ("", "", None),
    ],
)
def test_odd_pages(spark, page, title, text):
    (got,) = column(
        spark, [page],
        lambda c: T.bind(H.visible_markup(c), lambda m: F.struct(H.title(m).alias("title"), H.body_text(m).alias("text"))),
    )
    assert (got["title"], got["text"]) == (title, text)


def test_long_tag_and_page(spark):
    random.seed(1)
    attributes = " ".join(f'data-{i}="{i}"' for i in range(3000))
    page = f"<body><p {attributes}>" + "".join(f"<i>w{i}</i>&amp;" for i in range(20000)) + "<a href='x" + "y" * 100000 + "'>z</a>"
    (got,) = column(spark, [page], lambda c: F.length(H.body_text(H.visible_markup(c))))
    assert got == len("\n".join(f"w{i}\n&" for i in range(20000))) + 2


def test_json_documents_that_python_takes_are_kept(spark):
    texts = ['{"a":1,"a":2}', '{"a":NaN}', '{"b": 1, "a": [1, 2]}', "{broken", '{"a":1} x', '{"a":1},{"b":2}', "{'a':1}", "[1,2]",
             " null ", "", '{"x":1}]', "1] [2", "1}", '1, "v": 2', '{"u": "\\u00e9"}', "12"]

    def accepted(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", H.valid_json(F.array("t")).alias("v"))
    got = {texts[r["i"]]: r["v"] for r in rows.collect()}
    assert {t: bool(v) for t, v in got.items()} == {t: accepted(t) for t in texts}
    assert got['{"a":1,"a":2}'] == ['{"a":1,"a":2}'] and got['{"b": 1, "a": [1, 2]}'] == ['{"b":1,"a":[1,2]}']
