import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textinsight import session
from textinsight.operators import crawl, keywords, site
from textinsight.operators.prompts import pair_sites
from textinsight.operators.report import write_site_report
from textinsight.plans.sites import compare_sites, profile_sites


def shortest_paths(seed, links, max_depth):
    """The first path, as link positions, to each fetched URL of the host; shorter before longer ones."""
    host = seed.split("/")[2]
    level, best = {seed: ()}, {}
    for _ in range(max_depth + 1):
        best.update(level)
        steps = [(path + (at,), target) for url, path in level.items() for at, target in enumerate(links.get(url, ()))]
        new = [(path, t) for path, t in steps if t.split("/")[2] == host and t in links and t not in best]
        level = {t: min(p for p, u in new if u == t) for _, t in new}
    return {url: path for url, path in best.items() if url in links}


@pytest.mark.parametrize("seed, max_depth, max_pages", [(1, 2, 10), (2, 2, 4), (3, 5, 30), (4, 0, 5), (5, 3, 1)])
def test_walk_follows_the_first_shortest_paths(spark, seed, max_depth, max_pages):
    random.seed(seed)
    urls = [f"http://h{h}.example/{i}" for h in range(4) for i in range(25)]
    links = {
        url: [random.choice(urls[:50] if random.random() < 0.3 else [u for u in urls if u.split("/")[2] == url.split("/")[2]])
              for _ in range(random.randint(0, 6))]
        for url in urls if random.random() < 0.8
    }
    starts = [f"http://h{h}.example/0" for h in range(4)] + [urls[7], "http://nowhere.example/"]
    pages = spark.createDataFrame(
        [(i, url, "<p>" + "".join(f'<a href="{t}">x</a>' for t in targets)) for i, (url, targets) in enumerate(links.items())],
        "page_id long, url string, html string",
    )
    seeds = spark.createDataFrame([(start,) for start in starts], "seed string")
    walk = crawl.crawl_frontier(seeds, crawl.link_table(pages), max_depth, max_pages)
    got = {start: [] for start in starts}
    for row in walk.orderBy("seed", "ord").collect():
        got[row["seed"]].append((row["url"], row["depth"]))
    for start in starts:
        paths = shortest_paths(start, links, max_depth)
        order = sorted(paths, key=lambda url: (len(paths[url]), paths[url]))
        assert got[start] == [(url, len(paths[url])) for url in order[:max_pages]]


def test_a_url_that_all_seeds_want(spark, monkeypatch):
    """400 walks over one host, all through its first page; also with the lookups by shuffle."""
    urls = [f"http://hot.example/{i}" for i in range(400)]
    links = {url: [urls[0], urls[(i + 1) % 400]] for i, url in enumerate(urls)}
    pages = spark.createDataFrame(
        [(i, url, "".join(f'<a href="{t}">x</a>' for t in targets)) for i, (url, targets) in enumerate(links.items())],
        "page_id long, url string, html string")
    seeds = spark.createDataFrame([(u,) for u in urls], "seed string")
    for size in (500_000, 0):
        monkeypatch.setattr(session, "is_small", lambda df, max_rows=0, size=size: size > 0)
        rows = crawl.crawl_frontier(seeds, crawl.link_table(pages), 2, 4).collect()
        got = {}
        for row in sorted(rows, key=lambda r: (r["seed"], r["ord"])):
            got.setdefault(row["seed"], []).append(row["url"])
        for start in urls:
            paths = shortest_paths(start, links, 2)
            assert got[start] == sorted(paths, key=lambda url: (len(paths[url]), paths[url]))[:4]


def test_a_depth_reads_the_link_table_as_it_lies(spark):
    table = spark.createDataFrame([(f"u{i}", i, [f"u{i + 1}"]) for i in range(50)], "url string, page_id long, links array<string>")
    found = spark.createDataFrame([(f"s{i}", f"u{i % 9}") for i in range(60)], "seed string, url string")
    placed, name = session.bucketed(table, ["url"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = crawl.wanted_pages(placed, found)
        plan = wanted._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("FileScan")].split("Join")[-1]
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(url") == 1 and "Exchange" not in above
        assert sorted(r["url"] for r in wanted.collect()) == [f"u{i}" for i in range(9)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert session.unbucketed(spark, name).count() == 50 and not spark.catalog.tableExists(name)


def test_pairs_of_a_hot_seed(spark, monkeypatch):
    pairs = spark.createDataFrame([(i, "hot", f"s{i % 40}") for i in range(500)] + [(500, None, "s1"), (501, "gone", "hot")], "pair_id long, seed_a string, seed_b string")
    summaries = spark.createDataFrame([("hot", "H", None)] + [(f"s{i}", f"S{i}", None) for i in range(39)] + [("s39", None, "down")], "seed string, summary string, error string")
    for small in (True, False):
        monkeypatch.setattr(session, "is_small", lambda df, max_rows=0, small=small: small)
        rows = {r["pair_id"]: r for r in pair_sites(pairs, summaries).collect()}
        assert len(rows) == 502
        for i in range(500):
            assert rows[i]["summary_a"] == "H" and rows[i]["summary_b"] == (f"S{i % 40}" if i % 40 < 39 else None)
            assert rows[i]["error_b"] == ("down" if i % 40 == 39 else None)
        assert (rows[500]["summary_a"], rows[500]["summary_b"], rows[501]["summary_a"], rows[501]["summary_b"]) == (None, "S1", None, "H")


def test_fragments_ports_and_doubles(spark):
    pages = spark.createDataFrame(
        [
            (3, "http://a.example/", '<a href="#x">f</a><a href="//a.example:80/y">port</a><a href="/y">y</a><a href="y">again</a>'),
            (1, "http://a.example/y", "first copy"),
            (2, "http://a.example/y", '<a href="/z">second copy</a>'),
            (4, "http://a.example/#x", "fragment page"),
            (5, "http://a.example/z", "unreached"),
        ],
        "page_id long, url string, html string",
    )
    seeds = spark.createDataFrame([("http://a.example/",)], "seed string")
    rows = crawl.crawl_frontier(seeds, crawl.link_table(pages)).orderBy("ord").collect()
    assert [(row["ord"], row["page_id"]) for row in rows] == [(1, 3), (2, 4), (3, 1)]


def test_site_keywords_equal_a_counter(spark):
    random.seed(9)
    vocabulary = ["alpha", "beta", "gamma", "https", "wwwhat", "abc", "delta", "omega"]
    texts = [" ".join(random.choices(vocabulary, k=30)) for _ in range(40)]
    df = spark.createDataFrame([(i, i % 3 // 2, text) for i, text in enumerate(texts)], "ord long, seed long, text string")
    got = {}
    for row in keywords.site_keywords(df, top_n=4).orderBy("rank").collect():
        got.setdefault(row["seed"], []).append((row["word"], row["n"]))
    for group in (0, 1):
        words = [w for i, text in enumerate(texts) if i % 3 // 2 == group for w in text.split()]
        kept = [w for w in words if len(w) >= 4 and not w.startswith(("http", "www"))]
        assert got[group] == Counter(kept).most_common(4)


def test_profile_merges_pages_in_walk_order(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.example/", '<title> </title><body><h1>A</h1><a href="/b">next page</a></body>'),
            (2, "http://a.example/b", '<head><title>B</title><meta name="description" content="Desc">'
                                      '<script type="application/ld+json">{"k":1}</script></head><body><h1>B1</h1><h1>B2</h1>text text</body>'),
        ],
        "page_id long, url string, html string",
    )
    seeds = spark.createDataFrame([("http://a.example/",)], "seed string")
    (row,) = profile_sites(seeds, pages).collect()
    assert (row["title"], row["meta_description"], row["h1"]) == ("B", "Desc", ["A", "B1", "B2"])
    assert row["text"] == "A\nnext page\nB1\nB2\ntext text\n"
    assert row["structured_data"] == ['{"k":1}']
    assert row["keywords"] == ["text", "next", "page"]


def model():
    def make_client():
        def client(messages, temperature):
            return f"{temperature} {len(messages)}"

        return client

    return make_client


def test_compare_sites_and_write(spark, tmp_path):
    pages = spark.createDataFrame(
        [(i, f"http://s{i}.example/", f"<title>T{i}</title><body>x</body>") for i in range(3)],
        "page_id long, url string, html string",
    )
    pairs = spark.createDataFrame(
        [(1, "http://s0.example/", "http://s1.example/"), (0, "http://s2.example/", "http://s1.example/")],
        "pair_id long, seed_a string, seed_b string",
    )
    lines = compare_sites(pairs, pages, model())
    assert lines.count() == 10 and lines.filter("error is not null").count() == 0
    write_site_report(lines, str(tmp_path / "out"))
    text = [row["value"] for row in spark.read.text(str(tmp_path / "out")).orderBy(F.input_file_name()).collect()]
    assert text[:2] == ["a seed: http://s2.example/", "a summary: None 2"] and len(text) == 10


def test_no_pair_is_lost(spark):
    pages = spark.createDataFrame([(0, "http://s0.example/", "<title>T</title><body>x</body>")], "page_id long, url string, html string")
    pairs = spark.createDataFrame([(1, "http://s0.example/", "http://gone.example/")], "pair_id long, seed_a string, seed_b string")
    assert [r["line"] for r in compare_sites(pairs, pages, model()).orderBy("seq").collect()] == [
        "http://s0.example/", "None 2", "http://gone.example/", "None 2", "None 2"]

    def broken():
        def client(messages, temperature):
            raise ValueError("down")

        return client

    lines = compare_sites(pairs, pages, lambda: broken()).orderBy("seq").collect()
    assert [r["error"] for r in lines] == [None, "ValueError: down", None, "ValueError: down", "nothing to send"]
    profile = profile_sites(spark.createDataFrame([("http://gone.example/",)], "seed string"), pages).collect()
    assert [(r["title"], r["h1"], r["text"], r["keywords"]) for r in profile] == [("", [], "", [])]


def test_first_nonempty_skips_blank_pages(spark):
    fields = spark.createDataFrame(
        [("s", 1, ""), ("s", 2, "b"), ("s", 3, "c"), ("t", 1, "")], "seed string, ord long, title string"
    )
    got = {row["seed"]: row["title"] for row in site.first_nonempty(fields, "title").collect()}
    assert got == {"s": "b", "t": ""}
