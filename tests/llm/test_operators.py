"""Every operator against a brute-force version over the small tables, and on edge rows."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from textinsight.llm import bytegrams, components, language_id, lm_scoring, pii, simhash
from textinsight.llm import queries as Q
from textinsight.llm.common import global_rank
from textinsight.llm.decontamination import canonical_tokens, contaminated
from textinsight.llm.exact_dedup import exact_duplicates
from textinsight.llm.html_text import extract_pages, main_text
from textinsight.llm.license_scan import license_scan
from textinsight.llm.mixing import mix_sources, plan_mixture
from textinsight.llm.sharding import hilbert_index, hilbert_shards
from textinsight.session import lookup_join

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, level int, id long, row long, fp long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="module")
def edges(spark):
    long = " ".join(f"word{i % 977} and, of." for i in range(60_000))
    texts = [None, "", " \t\n", "one", "Two  words", "two words", long, long, "12 km for Tom", "ÄÖÜ ñandú", "\0\0\0\0"]
    data = [(i, t, None if i % 3 else "en", None if i % 4 == 3 else f"s{i % 2}", None, "x", 1, 2, 3, 4) for i, t in enumerate(texts)]
    data += [data[4], data[4], (None, "two words", None, None, None, None, None, None, None, None), data[0]]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def simhashed(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    votes = collections.Counter(
        b for s in shingles for h in [xxhash.xxh64(s.encode(), seed=42).intdigest()] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(shingles))


def grouped(values, linked):
    """Smallest member of each value's component."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


# --- 1: license scan

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base_places(spark, rows):
    found = Q.op1_license_scan(spark, SF_DIR).collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found}
    assert len(found) == len(rows) and got == {i: places(t) for i, t, *_ in rows}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)


def test_license_templates_with_changed_words(spark):
    texts = [
        "Licensed under the brand new GNU General Public License, Version 3!", "licensed under the gnu general public license version 2",
        "cc by nc cc by nc under the MIT-license", "the license of the gnu", "apache license and version 2",
        "you may never use this file except in strict compliance with the license",
    ]
    found = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in found] == ["", "gpl-2", "cc-by-nc,mit", "", "", ""] or found[0]["labels"] == "gpl-3"
    assert (found[2]["n_base"], found[2]["first_word"], found[2]["last_word"]) == (3, 0, 6)
    assert found[1]["score"] == 1.0 and found[3]["score"] == 0.0


# --- 2: main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var p="</p>";</script></head><body>
<div id="header"><p>The site, its name, and more, all of it long enough to count</p></div><nav><a href="/">Home</a></nav>
<div class="post-content"><h2>Head &amp; line</h2><p>First paragraph, with commas, and <b>bold <br>words</b> enough to count.
<p>Second&nbsp;paragraph &lt;also&gt; of some length, so that it gets its points.<ul><li>One item<li>Two items</ul></div>
<div class="comments"><p>I disagree with this, strongly, and write a comment of some length.</p></div>
<form><p>Subscribe to our letter, now, it is free and comes each week to you.</p></form>
<footer>Copyright</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n") == [
        "Head & line", "First paragraph, with commas, and bold words enough to count.",
        "Second paragraph <also> of some length, so that it gets its points.", "One item", "Two items",
    ]
    assert main_text("") == "" and main_text("plain  text") == "plain text" and main_text("<p>a<b>b</p></i>c") == "ab\nc"


def test_hidden_is_an_attribute_of_its_own():
    text = "A paragraph of the article, long enough to count, with commas."
    page = "<body><p>Tagline</p><div %s><p>" + text + "</p></div></body>"
    for shown in ('style="overflow:hidden"', 'class="overflow-hidden md:hidden"', 'title="hidden gems"', 'hidden="false"', 'data-x="display:none"'):
        assert text in main_text(page % shown), shown
    for gone in ("hidden", 'hidden=""', "HIDDEN", 'style="color:red; display : none"', 'aria-hidden="true"'):
        assert text not in main_text(page % gone), gone


def test_articles_under_names_of_layouts():
    texts = [f"Paragraph {i} of the article, which is long enough to count, with commas, and words." for i in range(6)]
    body = "".join(f"<p>{t}</p>" for t in texts)
    for name in ("content sidebar-left", "container header-fixed", "hentry tag-python", "page menu-open", "main search-results", "entry social-policy"):
        assert main_text(f'<body><p>A tagline of the site.</p><div class="{name}">{body}</div></body>').split("\n")[-6:] == texts, name
    wrapped = "".join(f"<section><div><p>{t}</p></div></section>" for t in texts[:4])
    assert main_text(f"<body><div>{wrapped}</div><footer>end</footer></body>").split("\n") == texts[:4]
    two = f"<article><p>{texts[0]}</p></article><article><p>{texts[1]} {texts[2]}</p></article>"
    assert main_text(f"<body><div>{two}</div></body>").split("\n") == [texts[0], f"{texts[1]} {texts[2]}"]
    items = [f"Author {i}, the title of a work that was cited" for i in range(3)]
    listed = "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(items))
    assert main_text(f"<body><article>{body}<ul>{listed}</ul></article></body>").split("\n") == texts + items
    menu = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(5))
    assert main_text(f"<body><article><ul>{menu}</ul>{body}</article></body>").split("\n") == texts
    headed = f'<article><header><h1>The title</h1><span>By somebody</span></header>{body}</article>'
    assert main_text(f"<body><header><h1>The site</h1></header>{headed}</body>").split("\n") == ["The title", *texts]
    work = f'<section class="related-work"><h2>Related work</h2><p>{texts[5]}</p></section>'
    assert main_text(f"<body><article>{body}{work}</article></body>").split("\n") == [*texts, "Related work", texts[5]]
    for gone in ('<div class="related-posts"><a href="/a">One more post of this site to read</a> <a href="/b">Another post</a></div>',
                 '<div class="newsletter"><p>Subscribe to our letter, now, it is free and comes each week.</p></div>',
                 f'<div class="comments">{body * 3}</div>'):
        assert main_text(f"<body><div>{body}{gone}</div></body>").split("\n") == texts, gone


def test_unmatched_ends_take_linear_time():
    def seconds(n):
        page = "<div>" * 2000 + "</i>" * n + "<p>" + "text " * 20
        start = time.perf_counter()
        assert main_text(page) == ("text " * 20).strip()
        return time.perf_counter() - start

    assert seconds(40_000) < 20 * max(seconds(4_000), 0.02)
    assert main_text("x " * 2_000_000) == ("x " * 2_000_000).strip()  # a very long text


def test_pages_hold_their_article(spark):
    found = Q.op2_html_extraction(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert found
    for r in found:
        body = re.search(r"<article>(.*?)(?=</article>|<footer|\Z)", r.html, re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:h1|p)>", "\0", body).replace("<br>", " "))
        for entity, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
            body = body.replace(entity, char)
        assert r.text == "\n".join(" ".join(b.split()) for b in body.split("\0") if b.strip())
        assert r.n_chars == len(r.text)


def test_pages_edges(spark):
    table = spark.createDataFrame([(1, "u", None, 0), (2, None, "", 0), (2, None, "", 0), (None, "u", "<p>" * 3000 + "deep", 0)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in extract_pages(table).collect()) == ["", "", "", "deep"]
    assert extract_pages(table.limit(0)).count() == 0


# --- 3: language

def test_language_of_held_out_documents(spark, rows):
    found = {r.doc_id: r for r in Q.op3_language_id(spark, SF_DIR).collect()}
    assert len(found) == len(rows)
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    held = [(lang, found[i].lang_pred) for i, _, lang, _ in rows if found[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_partial_matching_code_lengths():
    text = b"\0\0\0\0abracadabra"
    keys = np.concatenate([k for k, _, _ in bytegrams.contexts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))])
    found, counts = np.unique(keys, return_counts=True)
    model = language_id.PartialMatching(["x"], np.zeros(len(found), int), found, counts)

    seen = collections.defaultdict(collections.Counter)
    for i in range(4, len(text)):
        for d in range(5):
            seen[text[i - d : i]][text[i]] += 1

    def bits(context, byte):
        for d in range(4, -1, -1):
            c = seen.get(context[4 - d :])
            if c:
                n, q = sum(c.values()), len(c)
                if byte in c:
                    return math.log2((n + q) / c[byte]) + lost(context, d)
        return lost(context, -1) + 8

    def lost(context, above):
        return sum(math.log2((sum(c.values()) + len(c)) / len(c)) for d in range(4, above, -1) for c in [seen.get(context[4 - d :])] if c)

    asked = [(b"abra", b"c"[0]), (b"abra", b"z"[0]), (b"zzzz", b"a"[0]), (b"zbra", b"c"[0]), (b"\0\0\0\0", b"b"[0])]
    key = np.array([int.from_bytes(c + bytes([b]), "big") for c, b in asked], np.uint64)
    assert model.cost(key)[:, 0] == pytest.approx([bits(c, b) for c, b in asked], rel=1e-5)


def test_language_edges(edges, nothing):
    model = language_id.fit(edges)
    found = language_id.predict_language(edges, model).collect()
    assert len(found) == 15 and all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    assert language_id.fit(nothing) is None
    assert {r.lang_pred for r in language_id.predict_language(edges, None).collect()} == {"und"}


# --- 4: sharding

def test_hilbert_neighbours_touch(spark):
    cells = spark.range(16**3).select(*[F.expr(f"id div {16**k} % 16").alias(c) for k, c in enumerate("xyz")])
    got = cells.withColumn("h", hilbert_index([F.col(c) for c in "xyz"], 4)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(16**3))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(got, got[1:]))


def check_shards(found, texts, shards=40):
    sizes = collections.defaultdict(list)
    for r in found:
        sizes[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values()) and set(sizes) <= set(range(shards))
    counts = [len(sizes.get(s, [])) for s in range(shards)]
    assert sum(counts) == len(texts) and max(counts) - min(counts) <= 1
    assert sorted((r.size, r.text_crc32) for r in found) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)


def test_shards(spark, rows, edges, nothing):
    check_shards(Q.op4_hilbert_shards(spark, SF_DIR).collect(), [t for _, t, *_ in rows])
    check_shards(hilbert_shards(edges).collect(), [r.text for r in edges.collect()])
    assert hilbert_shards(nothing).count() == 0


def test_global_rank_does_not_depend_on_partitions(spark):
    table = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    for n in (1, 4, 7):
        got = global_rank(table.repartition(n), ["g", "k"], "r").orderBy("r").collect()
        assert [(r.g, r.k) for r in got] == sorted((r.g, r.k) for r in got) and [r.r for r in got] == list(range(1000))


# --- 5: mixing

def test_mixture_meets_its_targets(spark):
    big = {"a": 600, "b": 250, "c": 20, None: 5}
    table = spark.createDataFrame([(i, "w " * (i % 9), s, 0) for s, n in big.items() for i in range(n)], "doc_id long, text string, source string, mix_block int")
    tokens = {s: sum(i % 9 for i in range(n)) for s, n in big.items()}
    total = sum(tokens.values())
    free = {r.source: r for r in plan_mixture(table, max_repeats=1000.0).collect()}
    entropy = -sum(r.weight * math.log(r.weight) for r in free.values())
    assert entropy == pytest.approx(0.95 * math.log(4), abs=1e-6) and sum(r.weight for r in free.values()) == pytest.approx(1)
    plan = {r.source: r for r in plan_mixture(table, max_repeats=4.0).collect()}
    assert max(r.weight * total / tokens[s] for s, r in plan.items()) == pytest.approx(4, rel=1e-5)
    out = mix_sources(table, max_repeats=4.0).collect()
    taken = collections.Counter()
    for r in out:
        taken[r.source] += len(r.text.split())
    assert all(plan[s].quota - 9 < taken[s] <= plan[s].quota for s in big)
    whole = collections.Counter((r.source, r.mix_block) for r in out)
    assert all(whole[s, b] == big[s] for s, b in whole if b < plan[s].blocks)
    assert max(collections.Counter((r.source, r.mix_block, r.doc_id) for r in out).values()) == 1
    # At any point of the mixture the largest source is at its weight.
    first = [r for r in out if r.mix_place < 0.5]
    assert sum(len(r.text.split()) for r in first if r.source == "a") / plan["a"].quota == pytest.approx(0.5, abs=0.1)


def exponent_of(tokens, target, repeats, top):
    """The exponent by plain halving."""
    shares = [t / sum(tokens) for t in tokens if t]

    def at(x):
        z = sum(p**x for p in shares)
        w = [p**x / z for p in shares]
        return -sum(v * math.log(v) for v in w), max(v / p for v, p in zip(w, shares))

    def first(holds, low, high):
        if holds(*at(low)):
            return low
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if holds(*at(middle)) else (middle, high)
        return high

    x = first(lambda e, m: e < target * math.log(len(shares)), 0.0, top)
    if x < 1:
        return max(x, first(lambda e, m: m <= repeats, 0.0, 1.0))
    return min(x, first(lambda e, m: m > repeats, 1.0, top)) if x > 1 else x


@pytest.mark.parametrize("target, repeats, top", [(0.5, 9.0, 16.0), (0.5, 1.5, 16.0), (0.999, 1.1, 16.0), (0.2, 9.0, 3.0)])
def test_exponent_equals_plain_halving(spark, target, repeats, top):
    tokens = {"a": 300, "b": 200, "c": 100}
    table = spark.createDataFrame([(i, "w", s) for s, n in tokens.items() for i in range(n)], "doc_id long, text string, source string")
    got = {r.exponent for r in plan_mixture(table, target_entropy=target, max_repeats=repeats, max_exponent=top).collect()}
    assert len(got) == 1 and got.pop() == pytest.approx(exponent_of(tokens.values(), target, repeats, top), abs=1e-6)


def test_mixing_edges(edges, nothing):
    assert mix_sources(edges).select("doc_id").distinct().count() > 5 and mix_sources(nothing).count() == 0
    assert set(mix_sources(edges).columns) == {*edges.columns, "mix_block", "mix_place"}
    blank = edges.filter("trim(text) = '' or text is null")
    assert mix_sources(blank).count() == blank.count()


# --- 6: personal data

PRIVATE = [
    "Write to ann.b-7@mail3.example.com or ANN.B-7@MAIL3.EXAMPLE.COM, call +1 (974) 555-3436.", "at 10.0.0.7 and 97.51.17.173, card 9807915762804490",
    'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" B44E15E09FD311C3CF3163B66D5A9875B883D8CE!!', "Mrs. Smith met Anna Müller and John Ångström; Анна Иванова",
    "version 1.2.3, year 2024, 12 apples", "123-45-6789",
]


def test_surrogates(spark):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE)], "doc_id long, text string")
    got = [r.text for r in pii.replace_personal_data(table, "k").orderBy("doc_id").collect()]
    assert got == [r.text for r in pii.replace_personal_data(table, "k").orderBy("doc_id").collect()]
    assert got != [r.text for r in pii.replace_personal_data(table, "other").orderBy("doc_id").collect()]
    assert got[4] == PRIVATE[4]
    mail, loud = re.findall(r"\S+@\S+\.(?:com|COM)", got[0])
    assert mail.upper() == loud and mail != "ann.b-7@mail3.example.com" and re.fullmatch(r"[a-z]{3}\.[a-z]-\d@[a-z]{4}\d\.[a-z]{7}\.com", mail)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.$", got[0]) and "555-3436" not in got[0]
    a, b = re.findall(r"\d+\.\d+\.\d+\.\d+", got[1])
    assert a != b and all(int(x) < 256 for x in (a + "." + b).split(".")) and re.search(r"card \d{16}$", got[1])
    key, upper = re.findall(r"[0-9a-fA-F]{40}", got[2])
    assert key.upper() == upper and key not in PRIVATE[2]
    assert re.fullmatch(r"Mrs\. \p{Lu}\p{Ll}{4} met .*".replace(r"\p{Lu}", "[A-Z]").replace(r"\p{Ll}", "[a-z]"), got[3])
    given = re.search(r"met (\w+) (\w)(\w+) and (\w+) ", got[3])
    assert given[1] in pii.GIVEN_NAMES[1] and given[4] in pii.GIVEN_NAMES[0] and re.search(r"; [А-Яа-яё]+ [А-Я][а-яё]+$", got[3])
    assert not any(x in " ".join(got) for x in ("Smith", "Müller", "Ångström", "Иванова", "123-45-6789"))


def test_surrogates_stay_distinct(spark):
    kinds = {"card": [f"{i:016d}" for i in range(3000)], "address": [f"10.0.{i // 200}.{i % 200}" for i in range(3000)]}
    for kind, values in kinds.items():
        table = spark.createDataFrame([(kind, v) for v in values], "kind string, found string")
        new = [r[0] for r in table.select(pii.surrogate(F.col("kind"), F.col("found"), F.lit("k|0"))).collect()]
        assert len(set(new)) == len(values)


def test_given_names_of_one_family_stay_distinct(spark):
    families = ["Smith", "SMITH", "Jones", "O'Neill-Li"]
    texts = [f"by {given} {family}." for names in pii.GIVEN_NAMES for given in names for family in families]
    got = pii.replace_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "surrogates").collect()
    assert len({r.text for r in got}) == len(texts) and all(r.n_replaced == 1 for r in got)


def test_surrogate_edges(edges, nothing):
    got = pii.replace_personal_data(edges, "k")
    assert got.columns == [*[c for c in edges.columns if c != "text"], "text", "n_replaced"]
    assert sorted((r.text or "", r.doc_id is None) for r in got.collect()) == sorted((r.text or "", r.doc_id is None) for r in edges.collect())
    assert pii.replace_personal_data(nothing, "k").count() == 0


# --- 7: near duplicates

def test_near_duplicates(spark, rows):
    prints = {i: simhashed(t) for i, t, *_ in rows}
    want = grouped(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op7_simhash_near_dedup(spark, SF_DIR).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("bucket, segments", [(1, 3), (4, 2), (128, 3), (128, 5)])
def test_links_with_full_buckets(spark, bucket, segments):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    prints = {b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(15)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.near_links(nodes, 4, segments, bucket)
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    close = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    assert all(close(r.a, r.b) for r in links.collect())
    assert {p: roots.get(p, p) for p in signed} == grouped(signed, close)


def test_probes_are_not_broadcast(spark):
    links = simhash.near_links(spark.range(1000).select(F.xxhash64("id").alias("fp")))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_salted_copies_are_not_broadcast(spark):
    left = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    joined = lookup_join(left, spark.range(5).select(F.col("id").alias("k"), F.lit("v").alias("v")), ["k"], "id", "left", max_rows=1)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(joined.select("id", "v").collect()) == [(i, "v" if i % 7 < 5 else None) for i in range(1000)]


def test_bit_majority_over_chunks(monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK", 3)
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(1 << 62), 1 << 62, 50)
    bounds = np.array([0, 0, 7, 8, 30, 50, 50])
    want = []
    for a, b in zip(bounds, bounds[1:]):
        want.append(sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in hashes[a:b]) > b - a))
    assert [int(x) & ((1 << 64) - 1) for x in simhash.bit_majority(hashes, bounds[:-1], bounds[1:])] == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100)}


def test_near_duplicate_edges(edges, nothing):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == 15 and {r.component_id for r in got if r.fp == 0} == {0}
    assert {r.component_id for r in got if r.doc_id in (4, 5, None)} == {4}
    assert simhash.near_duplicates(nothing).count() == 0


# --- 8: language model

def test_word_scores(spark, rows):
    tokens = {i: [*words(t), " "] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for frequent in (50_000, 20):  # the second looks most words up by shuffle
        got = lm_scoring.score_documents(docs, train, frequent=frequent).collect()
        assert len(got) == len(rows)
        for r in got:
            w = tokens[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
            assert r.score < 0 and r.bits_per_byte > 0


def weighted(counts, gram):
    """Log10 probability of a byte after its context: recursive weighting over all contexts, one decision at a time."""
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def seen(suffix, prefix, j):
        """Zeros and ones of decision j of the bytes that begin with these bits, after contexts that end so."""
        out = [0, 0]
        for (c, x), n in counts.items():
            if c.endswith(suffix) and x >> (8 - j) == prefix:
                out[x >> (7 - j) & 1] += n
        return out

    def node(suffix, prefix, j):
        a, b = seen(suffix, prefix, j)
        own = kt(a, b) if a + b else 0.0
        if len(suffix) == 4 or not a + b:
            return own, own
        children = {c[3 - len(suffix) :] for c, _ in counts if c.endswith(suffix)}
        split = sum(node(child, prefix, j)[0] for child in children)
        return np.logaddexp(own, split) - math.log(2), own - split

    context, byte = gram
    total = 0.0
    for j in range(8):
        prefix, bit = byte >> (8 - j), byte >> (7 - j) & 1
        guess = None
        for depth in range(4, -1, -1):
            suffix = context[4 - depth :]
            a, b = seen(suffix, prefix, j)
            if a + b:
                own = (b + 0.5) / (a + b + 1)
                w = math.exp(node(suffix, prefix, j)[1])
                guess = own if guess is None else (w * own + guess) / (w + 1)
        p = 0.5 if guess is None else guess if bit else 1 - guess
        total += math.log10(p)
    return total


@pytest.mark.parametrize("rows", [1 << 17, 5])
def test_code_lengths_equal_the_recursion(spark, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "_ROWS", rows)
    draw = random.Random(4)
    train = ["".join(draw.choices("abé", k=draw.randint(0, 30))) for _ in range(12)]
    held = ["".join(draw.choices("abzé", k=draw.randint(0, 12))) for _ in range(4)] + [None]
    split = lambda t: [(b[i - 4 : i], b[i]) for b in [b"\0\0\0\0" + (t or "").encode() + b"\0"] for i in range(4, len(b))]
    counts = collections.Counter(g for t in train for g in split(t))
    docs = spark.createDataFrame([(t, True) for t in train] + [(t, False) for t in held], "text string, learn boolean")
    grams = lm_scoring.gram_counts(docs)
    got = {(r.gram >> 8).to_bytes(4, "big") + bytes([r.gram & 255]): r for r in lm_scoring.code_lengths(grams).collect()}
    want = {g for t in [*train, *held] for g in split(t)}
    assert set(got) == {c + bytes([x]) for c, x in want}
    for c, x in want:
        r = got[c + bytes([x])]
        assert r.n == counts[c, x] and r.cost == pytest.approx(weighted(counts, (c, x)), abs=1e-9)
    # the probabilities of all bytes after a context add up to one
    every = spark.createDataFrame([(int.from_bytes(c, "big") << 8 | x, counts[c, x]) for c in {c for c, _ in want} for x in range(256)], "gram long, n long")
    sums = collections.Counter()
    for r in lm_scoring.code_lengths(every).collect():
        sums[r.gram >> 8] += 10**r.cost
    assert list(sums.values()) == pytest.approx([1] * len(sums))
    for few in (10, 1 << 20):  # the first looks nearly all grams up by shuffle
        scored = lm_scoring.score_documents(docs.withColumn("doc_id", F.monotonically_increasing_id()), F.col("learn"), frequent_grams=few).collect()
        assert sorted(r.score for r in scored) == pytest.approx(sorted(sum(got[c + bytes([x])].cost for c, x in split(t)) for t in [*train, *held]))


def test_language_model_edges(edges, nothing):
    got = lm_scoring.score_documents(edges, F.col("doc_id") % 2 == 0).collect()
    assert len(got) == 15 and all(r.n_tokens == len(words({x.doc_id: x.text for x in edges.collect()}[r.doc_id])) + 1 for r in got)
    assert lm_scoring.score_documents(nothing, F.lit(True)).count() == 0
    untrained = lm_scoring.score_documents(edges, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.score == pytest.approx(-(r.n_bytes + 1) * math.log10(256)) for r in untrained)


def test_lookup_finds_all_keys():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 40, 5000).astype(np.uint64))
    asked = np.concatenate([keys[::-1], keys + np.uint64(1 << 50)])
    assert (bytegrams.Lookup(keys).find(asked) == np.concatenate([np.arange(len(keys))[::-1], np.full(len(keys), -1)])).all()


def test_contexts_over_chunks(monkeypatch):
    texts = [b"\0\0\0\0" + t for t in (b"", b"hello world", b"x", b"abcdefghij" * 3)] + [b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [(o, int.from_bytes(t[i - 4 : i + 1], "big")) for o, t in enumerate(texts) for i in range(4, len(t))]
    for chunk in (1, 3, 7, 1000):
        monkeypatch.setattr(bytegrams, "CHUNK", chunk)
        got = []
        for keys, owner, starts in bytegrams.contexts(data, offsets):
            ends = [*starts[1:], len(keys)]
            got += [(int(o), int(k)) for o, a, b in zip(owner, starts, ends) for k in keys[a:b]]
        assert got == want


# --- 9: exact duplicates

def weak(block):
    return F.length(block).cast("bigint"), F.lit(0).cast("bigint")


@pytest.mark.parametrize("options", [{}, {"block_bytes": 7}, {"block_bytes": 64, "locate": weak}])
def test_exact_duplicates_of_edges(edges, options):
    source = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in edges.collect()]
    if options.get("block_bytes") == 7:
        source = [(i, t[:2000]) for i, t in source]
        edges = edges.withColumn("text", F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), 1, 2000))
    got = exact_duplicates(edges, **options).collect()
    sizes = collections.Counter(t for _, t in source)
    least = {t: min((i for i, x in source if x == t and i is not None), default=None) for t in sizes}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size) for r in got) == sorted((i is None, i or 0, least[t], sizes[t]) for i, t in source)
    assert sum(r.kept for r in got) == len(sizes)


def test_exact_duplicates_of_nothing(nothing):
    assert exact_duplicates(nothing).count() == 0


# --- 10: decontamination

ITEMS = [
    (1, "Tom has 3 apples and buys 12 kg of pears while Ann has 3 plums, so how many fruits does Tom have in the end?"),
    (2, "A short item."), (3, None), (4, "the river runs down to the sea and the wind blows over the hill at night"),
]
HELD = [
    (1, "Before. Tom has 3 apples and buys 12 kg of pears while Ann has 3 plums, so how many fruits does Tom have in the end? After."),
    (2, "Jim has 5 apples and buys 20 lbs of pears while Eve has 5 plums, so how many fruits does Jim have in the end?"),
    (3, "Jim has 5 apples and buys 20 kg of pears while Eve has 7 plums, so how many fruits does Bob have in the end?"),
    (4, "The river runs down to the blue sea, and the wind blows over the hill at night!"), (5, "nothing here at all of the kind"), (6, None),
    (7, "THE RIVER RUNS DOWN TO THE SEA AND THE WIND BLOWS OVER THE HILL AT NIGHT"), (7, "THE RIVER RUNS DOWN TO THE SEA AND THE WIND BLOWS OVER THE HILL AT NIGHT"),
]


def test_contaminated(spark):
    got = contaminated(spark.createDataFrame(HELD, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.exact) for r in got) == [(1, 1, True), (2, 1, False), (4, 4, True), (7, 4, True)]


def test_number_series_and_edited_figures(spark):
    items = [
        (1, "2, 4, 8, 16, 32, 64"), (2, "assert f([1, 2, 3, 4, 5, 6]) == 21"), (3, "5 km 8 kg 3 km 9 kg"), (4, ITEMS[0][1]),
        (5, "Give the series 2, 4, 8, 16, 32, 64 and please tell the very next number of it now"),
    ]
    many = ", ".join(str(i * 7 % 101) for i in range(400))
    texts = [
        (1, "2, 4, 8, 16, 32, 64"), (2, f"{many}, 2, 4, 8, 16, 32, 64, {many}"), (3, "So assert f([1, 2, 3, 4, 5, 6]) == 21 holds."),
        (4, "first 5 km 8 kg 3 km 9 kg then"), (5, many), (6, ITEMS[0][1].replace("3 plums", "4 plums")),
        (7, items[4][1].replace("please tell", "please do tell")), (8, "Give the series 3, 6, 9, 12, 15, 18 and please do tell the very next number of it now"),
        (9, "7 km 1 kg 2 km 6 kg"),
    ]
    got = contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.exact) for r in got) == [
        (1, 1, True), (2, 1, True), (3, 2, True), (4, 3, True), (6, 4, False), (7, 1, True), (7, 5, True), (8, 5, False)]
    assert {(r.doc_id, r.item_id): r.place for r in got}[2, 1] == 400


RECASED = [
    (1, ITEMS[0][1].lower()), (2, ITEMS[0][1].upper()), (3, ITEMS[0][1].replace(" Tom", "\n Tom").replace(" Ann", "  Ann").replace(" ", " \t")),
    (4, "So: WHAT is\n2+2 ? Nobody knows."), (5, "What is 2+3?"), (6, "the four   word ITEM, it is"), (7, "the four words item"), (8, "Yes, yes."),
]
SHORT = [ITEMS[0], (2, "What is 2+2?"), (3, "The four word item"), (4, "Yes")]


@pytest.mark.parametrize("max_windows", [500_000, 0])
def test_recased_respaced_and_short_items(spark, max_windows):
    frames = [spark.createDataFrame(r, f"{i} long, text string") for r, i in ((RECASED, "doc_id"), (SHORT, "item_id"))]
    got = contaminated(*frames, max_windows=max_windows).collect()
    assert sorted((r.doc_id, r.item_id, r.exact) for r in got) == [(1, 1, True), (2, 1, True), (3, 1, True), (4, 2, True), (6, 3, True)]


def test_number_tables_do_not_meet_in_all_pairs(spark):
    draw = random.Random(7)
    numbers = lambda n: ", ".join(str(draw.randrange(1000)) for _ in range(n))
    apart = lambda n: ", ".join(map(str, draw.sample(range(10_000), n)))
    table = numbers(1000)
    items = [(1, table), (2, "Sum up these numbers please: " + apart(300)), (3, ", ".join(["0"] * 60))]
    texts = [(1, numbers(20_000)), (2, numbers(20_000) + ", " + table), (3, ", ".join(["0"] * 3000)),
             (4, "Sum up these numbers please: " + apart(300)), (5, "Sum up these numbers please: 1, 2, 3"), (6, "Sum up these numbers please: " + numbers(100))]
    got = contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.exact) for r in got} == {(2, 1, True), (3, 3, True), (4, 2, False)}
    assert {r.doc_id: r.place for r in got}[2] == 20_000


def held_items(texts, items, window=5, coverage=0.5, slack=3):
    """Which documents hold which items, by looking at every pair of windows."""
    mark = re.compile("[\x01-\x03]")
    plain = lambda tokens: [mark.sub("", t) for t in tokens]
    shape = lambda tokens: [t[0] if mark.match(t) else t for t in tokens]
    found = set()
    for (d, doc), (i, item) in itertools.product(texts, items):
        size = min(window, len(item))
        if size < 2:
            continue
        starts = range(len(item) - size + 1)
        whole = coverage * len(starts)
        same = [(at - j, j) for at in range(len(doc) - size + 1) for j in starts if plain(doc[at : at + size]) == plain(item[j : j + size])]
        if any(len({j for _, j in run}) >= whole for run in runs_of(same, slack)):
            found.add((d, i))
        if size < window:
            continue
        worded = [any(not mark.match(t) for t in item[j : j + size]) for j in starts]
        like = [(at - j, j) for at in range(len(doc) - size + 1) for j in starts if worded[j] and shape(doc[at : at + size]) == shape(item[j : j + size])]
        ahead = {a for a, _ in like}
        like += [(a, j) for a in ahead for j in starts if not worded[j] and 0 <= a + j <= len(doc) - size and shape(doc[a + j : a + j + size]) == shape(item[j : j + size])]
        for run in runs_of(like, slack):
            for part in [run, *([x for x in run if x[0] == a] for a in {a for a, _ in run})]:
                if fits(doc, item, part, run, size, whole, worded, mark):
                    found.add((d, i))
    return found


def runs_of(hits, slack):
    out = []
    for hit in sorted(hits):
        if out and hit[0] - out[-1][-1][0] <= slack:
            out[-1].append(hit)
        else:
            out.append([hit])
    return out


def fits(doc, item, part, run, size, whole, worded, mark):
    def stretch(a, j):
        there = {x for x in run if x[0] == a}
        low = high = j
        while (a, low - 1) in there:
            low -= 1
        while (a, high + 1) in there:
            high += 1
        return high - low + 1

    equal = lambda a, j: all(x == y for x, y in zip(doc[a + j : a + j + size], item[j : j + size]) if mark.match(y))
    best = {}
    for a, j in sorted(part, key=lambda x: (x[1], not equal(*x), -stretch(*x), x[0])):
        best.setdefault(j, a)
    slots = {(j + k, item[j + k], doc[a + j + k]) for j, a in best.items() for k in range(size) if mark.match(item[j + k])}
    edited = sum(x != y for _, x, y in slots)
    among = collections.Counter(x for _, x, _ in slots)
    astray = sum(1 for _, x, y in slots if 2 * sum(s[1:] == (x, y) for s in slots) <= among[x])
    return len(best) >= whole and any(worded[j] for j in best) and (2 * edited < len(slots) or 4 * astray <= len(slots))


def test_contaminated_equals_all_pairs_of_windows(spark):
    draw = random.Random(11)
    vocabulary = ["red", "blue", "hill", "runs", "Tom", "Ann", "3", "4", "12", "km", "kg", "of"]
    make = lambda n: draw.choices(vocabulary, k=n)
    items = [(i, make(draw.choice([1, 2, 3, 4, 6, 9, 14]))) for i in range(25)]
    texts = []
    for d in range(60):
        words = make(draw.randint(0, 12))
        for _, item in draw.sample(items, 2):
            swap = {w: draw.choice([w, w, "5", "7", "Eve", "Jim"]) for w in item}
            copy = [swap[w] if w in {"3", "4", "12", "Tom", "Ann"} and d % 3 else w for w in item]
            if copy and d % 4 == 0:
                copy.insert(draw.randrange(len(copy)), "new")
            words += copy + make(draw.randint(0, 3))
        texts.append((d, words))
    frames = [spark.createDataFrame([(i, "a " + " ".join(w)) for i, w in rows], f"{name} long, text string") for rows, name in ((texts, "doc_id"), (items, "item_id"))]
    tokens = lambda df: [(r[0], list(r[1])) for r in df.select(df.columns[0], canonical_tokens(F.col("text"))).collect()]
    got = {(r.doc_id, r.item_id) for r in contaminated(*frames).collect()}
    want = held_items(tokens(frames[0]), tokens(frames[1]))
    assert got == want and len(want) > 30


def test_planted_items_are_found(spark, rows):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(i, b.item_id) for i, t, *_ in rows for b in items if plain(b.text) in plain(t)}
    got = {(r.doc_id, r.item_id) for r in Q.op10_template_decontamination(spark, SF_DIR).collect()}
    assert want and got == want


def test_contaminated_edges(edges, nothing, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contaminated(edges, items).count() == 0 and contaminated(nothing, items).count() == 0
    assert contaminated(edges, items.limit(0)).count() == 0


# --- pipeline

def test_pipeline(spark, rows):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    by_id, columns = {i: (t, lang) for i, t, lang, _ in rows}, docs.columns
    step, kept = docs, set(by_id)
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = kept
        step = stage(spark, step, SF_DIR)
        assert step.columns == columns
        kept = {r.doc_id for r in step.collect()}
        assert kept <= before and len(kept) > 0.8 * len(before), name
    prints = {i: simhashed(by_id[i][0]) for i in kept}
    assert all((prints[a] ^ prints[b]).bit_count() > 4 for a in kept for b in kept if a < b)
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in found} <= kept
    check_shards(found, [by_id[r.doc_id][0] for r in found])


def test_near_dedup_stage_keeps_texts_that_share_an_id(spark):
    long = " ".join(f"word{i}" for i in range(60))
    data = [(1, long), (1, long), (2, long), (2, "a text of its own, " * 9), (None, "another one altogether " * 9), (None, long), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_near_copies(spark, df, SF_DIR).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept if r.doc_id != 3) == [
        (False, 1, long), (False, 2, data[3][1]), (True, 0, data[4][1])]
    assert [r.doc_id for r in kept if not r.text] == [3]  # no text and an empty one are alike


def test_pipeline_edges(spark, edges, nothing):
    for table in (edges, nothing):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, SF_DIR).count() <= 40
