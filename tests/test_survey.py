import math
import random
import time
import uuid
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textinsight.functions.text import terms
from textinsight.operators import completion, grouping, keywords, kmeans, sentiment, tfidf
from textinsight.operators.completion import complete, prompt_key, read_ledger
from textinsight.operators.prompts import chat_messages
from textinsight.operators.report import write_report
from textinsight.plans.survey import analyze_survey, summarize_clusters
from textinsight.session import lookup_join
from textinsight.sources import responses as R

ANSWERS = [
    "Lower the renewal fee", "Renewal fee is too high", "Fees are high", "Nothing", "nothing", "N/A", ".", "x", "",
    "More webinars and classes", "Offer webinars", "Classes online are great", "The of and", "Great webinars, great staff",
    "It’s fine — really 🙂", "Not good", "Bad website",
]


def answers(spark, texts=ANSWERS):
    return spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "response_id long, response string")


def corpus(seed, n, groups=3, words=8):
    random.seed(seed)
    vocabulary = [f"w{chr(97 + i)}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [
        (i, random.choices(range(groups), [6, 2, 1][:groups])[0],
         " ".join(random.choices(vocabulary, weights, k=random.randint(0, 7))))
        for i in range(n)
    ]


def brute_group_tfidf(rows, cap):
    """Keyword scores per group, as the definitions say: {(group, term): score}."""
    scores = {}
    for group in {group for _, group, _ in rows}:
        docs = [text.split() for _, g, text in rows if g == group]
        docs = [Counter(doc + [f"{a} {b}" for a, b in zip(doc, doc[1:])]) for doc in docs]
        totals = Counter()
        for doc in docs:
            totals.update(doc)
        vocabulary = sorted(totals, key=lambda term: (-totals[term], term))[:cap]
        df = {term: sum(term in doc for doc in docs) for term in vocabulary}
        sums = defaultdict(float)
        for doc in docs:
            row = {t: doc[t] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in vocabulary if t in doc}
            norm = math.sqrt(sum(w * w for w in row.values()))
            for term, weight in row.items():
                sums[term] += weight / norm
        scores.update({(group, term): round(value, 6) for term, value in sums.items()})
    return scores


@pytest.mark.parametrize("cap", [1, 3, 5, 9, 30])
def test_bigram_pruning_is_exact(spark, cap):
    rows = corpus(cap, 150)
    df = spark.createDataFrame(rows, "response_id long, cluster long, response string")
    weights = tfidf.tfidf_by_group(df, stop_words=[], max_features=cap)
    got = {(r["cluster"], r["term"]): round(r["score"], 6) for r in keywords.term_scores(weights).collect()}
    assert got == brute_group_tfidf(rows, cap)
    norms = weights.groupBy("response_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(abs(row["s"] - 1) < 1e-9 for row in norms)


def test_candidates_are_found_without_a_scan_of_the_list_per_token(spark, monkeypatch):
    plans, cut = [], tfidf.cut_lineage
    monkeypatch.setattr(tfidf, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    rows = [(1, "a", "xx yy xx yy zz"), (1, "a", "zz xx"), (None, "b", "yy"), (2, "b", None), (3, None, "xx yy"), (4, "b", ""), (5, "b", "yy xx")]
    df = spark.createDataFrame(rows, "response_id long, cluster string, response string")
    got = tfidf.group_candidates(df, "cluster", "response_id", "response", [], 1).collect()
    assert not any("array_contains" in plan for plan in plans) and plans
    assert sorted((r[0], str(r[1]), sorted((c["term"], c["tf"]) for c in r["counts"])) for r in got) == [
        ("a", "1", [("xx", 1)]), ("a", "1", [("xx", 2), ("xx yy", 2)]), ("b", "5", [("yy", 1), ("yy xx", 1)]), ("b", "None", [("yy", 1)])]


def test_tfidf_paths_agree_and_have_unit_norm(spark):
    df = spark.createDataFrame(corpus(2, 400), "response_id long, cluster long, response string")
    small = tfidf.tfidf(df, stop_words=["wa"]).collect()
    salted = tfidf.tfidf(df, stop_words=["wa"], max_rows=0).collect()
    key = lambda row: (row["response_id"], row["term"])
    small, salted = sorted(small, key=key), sorted(salted, key=key)
    assert [key(row) for row in small] == [key(row) for row in salted]
    assert all(abs(a["weight"] - b["weight"]) < 1e-12 for a, b in zip(small, salted))


def test_salting_keeps_every_pair_of_a_hot_term(spark, monkeypatch):
    pairs = spark.range(5000).select(
        F.col("id").alias("response_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("term"),
        F.lit(1).cast("bigint").alias("tf"),
    )
    dictionary = tfidf.doc_frequency(pairs)
    hot = tfidf.hot_terms(dictionary)
    assert [row["term"] for row in hot.collect()] == ["hot"]
    joined = tfidf.term_join(pairs, dictionary.select("term", "df"), hot, F.col("response_id"), max_rows=0)
    assert joined.count() == 5000
    assert joined.filter("term = 'hot'").select("df").distinct().count() == 1


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_paths_agree(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k7", 3), ("unused", 4)], "key string, v int")
    small, salted = (
        sorted((row["id"], row["key"], row["v"] or 0) for row in lookup_join(left, right, ["key"], "id", how, limit).collect())
        for limit in (10, 0)
    )
    assert small == salted and sum(row[2] == 1 for row in small) == 2000


@pytest.mark.parametrize("k", [1, 3, 30])
def test_kmeans_invariants(spark, k):
    labelled = kmeans.kmeans_cluster(answers(spark), k, stop_words=["the", "of", "and"])
    rows = sorted(labelled.collect(), key=lambda row: row["response_id"])
    assert [row["response"] for row in rows] == ANSWERS
    seen = []
    for row in rows:
        if row["cluster"] not in seen:
            seen.append(row["cluster"])
    assert seen == list(range(len(seen))) and len(seen) <= k
    # equal rows of the term matrix get one label
    assert rows[3]["cluster"] == rows[4]["cluster"]
    assert rows[6]["cluster"] == rows[7]["cluster"] == rows[8]["cluster"]


def test_kmeans_without_any_term(spark):
    labelled = kmeans.kmeans_cluster(answers(spark, [".", "x", ""]), 2, stop_words=[])
    assert {row["cluster"] for row in labelled.collect()} == {0}


def test_kmeans_does_not_depend_on_partitions_and_takes_null(spark):
    rows = [(i, text) for i, text in enumerate(ANSWERS)] + [(len(ANSWERS), None)]
    df = spark.createDataFrame(rows, "response_id long, response string")
    got = [
        sorted((r["response_id"], r["cluster"]) for r in kmeans.kmeans_cluster(df.repartition(n), 3, stop_words=["the"], max_iter=3).collect())
        for n in (1, 4, 7)
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_lloyd_separates_clear_groups(spark):
    texts = ["red apple pie", "apple pie red", "red pie", "fast blue car", "blue car", "car fast blue"] * 5
    labels = kmeans.lloyd_kmeans(answers(spark, texts), 2, stop_words=[])
    by_text = defaultdict(set)
    for row in answers(spark, texts).join(labels, "response_id").collect():
        by_text["car" in row["response"]].add(row["cluster"])
    assert len(by_text[True]) == len(by_text[False]) == 1 and by_text[True] != by_text[False]


@pytest.mark.parametrize("score, label", [(0.1, "Neutral"), (-0.1, "Neutral"), (0.11, "Positive"), (-0.11, "Negative"), (0.0, "Neutral")])
def test_labels_at_the_bounds(spark, score, label):
    assert spark.range(1).select(sentiment.sentiment_label(F.lit(score)).alias("v")).first()["v"] == label


def test_polarity(spark):
    lexicon, negators = {"good": 0.7, "bad": -0.6, "not": 0.2}, ["not"]
    texts = ["good", "not good", "not", "", "plain words", "Bad, bad GOOD", "not not good", None]
    df = answers(spark, texts)
    want = [0.7, (0.2 - 0.35) / 2, 0.2, 0.0, 0.0, (-0.6 - 0.6 + 0.7) / 3, (0.2 - 0.1 - 0.35) / 3]
    got = df.select("response_id", sentiment.polarity(F.col("response"), lexicon, negators).alias("p")).orderBy("response_id").collect()
    assert [round(row["p"], 6) for row in got[:-1]] == [round(value, 6) for value in want]
    tables = (spark.createDataFrame(list(lexicon.items()), "word string, polarity double"),
              spark.createDataFrame([(word,) for word in negators], "word string"))
    for path in (sentiment.polarity_from_tables,):
        rows = {row["response_id"]: row["polarity"] for row in path(df, "response_id", "response", *tables).collect()}
        assert [round(rows[i], 6) for i in range(7)] == [round(value, 6) for value in want]


@pytest.mark.parametrize("budget", [1, 50, 10_000])
def test_parts_hold_every_answer_once_in_order(spark, budget):
    random.seed(budget)
    rows = [(i, "big" if i % 3 else f"g{i % 7}", "x" * random.randint(0, 9)) for i in range(600)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "response_id long, cluster string, response string").repartition(5)
    got = defaultdict(list)
    for row in sorted(grouping.group_responses(df, part_chars=budget).collect(), key=lambda r: (r["cluster"], r["part"])):
        got[row["cluster"]].append(row["responses"])
        assert sum(len(text) + 3 for text in row["responses"][:-1]) < budget or len(row["responses"]) == 1
    want = defaultdict(list)
    for _, cluster, text in sorted(rows):
        want[cluster].append(text)
    pieces = {cluster: sum(parts, []) for cluster, parts in got.items()}
    assert pieces == want if budget > 12 else {c: "".join(p) for c, p in pieces.items()} == {c: "".join(w) for c, w in want.items()}


def test_empty_answers_and_null_groups_fill_parts(spark):
    df = spark.range(200_000).select(F.col("id").alias("response_id"), F.lit(None).cast("string").alias("cluster"), F.lit("").alias("response"))
    parts = grouping.group_responses(df, part_chars=3000).select("cluster", "part", "n").collect()
    assert {r["n"] for r in parts} == {1000} and len(parts) == 200 and {r["cluster"] for r in parts} == {None}


def test_failed_parts_are_reported(spark):
    def mostly():
        def client(messages, temperature):
            if "bad" in messages[1]["content"]:
                raise ValueError("down")
            return '{"title": "T", "insight": "I", "actions": ["a"]}'

        return client

    data = [(0, "x", "good one"), (1, "x", "bad one"), (2, "x", "good two"), (3, None, "bad"), (4, "y", "fine")]
    df = spark.createDataFrame(data, "response_id long, cluster string, response string")
    got = {r["cluster"]: (r["parsed"]["title"], r["error"]) for r in summarize_clusters(df, "s", "q", lambda: mostly(), part_chars=11).collect()}
    assert got == {"x": ("T", "1 failed: ValueError: down"), "y": ("T", None), None: ("Cluster none - Undefined", "1 failed: ValueError: down")}


def test_report_of_string_groups(spark, tmp_path):
    rows = [(g, f"Cluster {g}", "body", "line") for g in ("b", "a", "c")]
    write_report(spark.createDataFrame(rows, "lang string, title string, body string, keyword_line string"), str(tmp_path / "out"), "S", "Q", group="lang")
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out")).orderBy(F.input_file_name()).collect()).split("\n")
    assert [line for line in text if line.startswith(("Cust", "Clus"))] == ["Customer Feedback Analysis Report", "Cluster a", "Cluster b", "Cluster c"]


def test_null_and_csv_sources(spark, tmp_path):
    path = tmp_path / "answers.csv"
    path.write_text('id,Response\n1,"Good, ""really"""\n2,N/A\n3,\n4,"two\nlines"\n5,none\n')
    rows = R.read_responses_csv(spark, str(path)).orderBy("response_id").collect()
    assert [row["response"] for row in rows] == ['Good, "really"', "two\nlines", "none"]


@pytest.mark.parametrize(
    "text, kept",
    [
        ("one\n two \n\nend\nthree", ["one", "two"]), ("a\r\n End \nb", ["a"]), ("END\nx", []),
        ("no marker\nhere", ["no marker", "here"]), ("weekend\nEND", ["weekend"]), ("", []),
    ],
)
def test_lines_until_marker(spark, tmp_path, text, kept):
    (tmp_path / "in.txt").write_bytes(text.encode())
    lines = R.lines_until_marker(R.read_lines(spark, str(tmp_path)), ["file"])
    assert [row["line"] for row in lines.orderBy("line_no").collect()] == kept


def test_split_responses_follows_python(spark):
    text = "a\r\nb\x0bc\x0cd\x1ce\x85f g  h \n\n\t\ni"
    rows = R.split_responses(spark.createDataFrame([(1, text)], "sid long, text string"), ["sid"]).orderBy("line_no")
    assert [row["response"] for row in rows.collect()] == [line.strip() for line in text.splitlines() if line.strip()]


def test_completion_errors_and_retries(spark):
    def flaky():
        failures = []

        def client(messages, temperature):
            text = messages[1]["content"]
            if text == "bad" or (text == "once" and not failures):
                failures.append(text)
                raise RuntimeError("down")
            return f"{messages[0]['role']} {text} {temperature}"

        return client

    df = answers(spark, ["good", "bad", "once"]).withColumn("messages", chat_messages("role", F.col("response")))
    rows = sorted(complete(df, flaky, 0.5, retries=1, parallelism=1).collect(), key=lambda row: row["response_id"])
    assert [row["reply"] for row in rows] == ["system good 0.5", None, "system once 0.5"]
    assert [row["error"] for row in rows] == [None, "RuntimeError: down", None]


def test_phrases_and_modifiers_from_left_to_right(spark):
    lexicon = {"good": 0.5, "bad": -0.6, "good for nothing": -0.8, "good for": 0.1, "out of date": -0.4}
    cases = {
        "good": 0.5, "not good": -0.25, "very good": 0.75, "not very good": -0.375, "very not good": -0.375, "very very good": 1.0,
        "good for nothing": -0.8, "good for many": 0.1, "not good for nothing": 0.4, "very a good": 0.625, "very a b good": 0.5,
        "not a good": -0.25, "not a b good": 0.5, "good bad": -0.05, "very good good": 0.625, "it is out of date": -0.4, "out of": 0.0,
        "": 0.0, "slightly bad": -0.3, "good for nothing good": -0.15, "not": 0.0, "very bad and not out of date": -0.35,
    }
    df = answers(spark, [*cases, None])
    score = sentiment.polarity(F.col("response"), lexicon, ["not"], {"very": 1.5, "slightly": 0.5}, 1)
    got = [r["p"] for r in df.select("response_id", score.alias("p")).orderBy("response_id").collect()]
    assert got[:-1] == pytest.approx(list(cases.values())) and got[-1] in (None, 0.0)
    plain = {"good": 0.5, "bad": -0.6}  # the state gives what the plain way gives
    both = [sentiment.polarity(F.col("response"), plain, ["not"], *more).alias(n) for n, more in (("a", ()), ("b", ({"none": 2.0},)))]
    assert all(r["a"] == r["b"] for r in df.filter("response is not null").select(*both).collect())


def test_a_killed_job_asks_no_finished_prompt_again(spark, tmp_path):
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()

    def counting(deadly, marks=str(calls)):
        def make_client():
            def client(messages, temperature):
                text = messages[1]["content"]
                if text == deadly:
                    time.sleep(1)
                    raise SystemExit("the executor is gone")
                with open(f"{marks}/{uuid.uuid4().hex}", "w") as mark:
                    mark.write(text)
                if text == "answer 5":
                    raise ValueError("refused")
                return text.upper()

            return client

        return make_client

    def asked():
        return sorted(mark.read_text() for mark in calls.iterdir())

    texts = [f"answer {i}" for i in range(40)] + ["answer 1"] * 3
    df = answers(spark, texts).withColumn("messages", F.when(F.col("response_id") != 7, chat_messages("role", F.col("response"))))
    with pytest.raises(Exception):
        complete(df, counting("answer 30"), 0.5, retries=0, ledger=ledger, batch=2)
    before = asked()
    done = {r["key"] for r in read_ledger(spark, ledger).filter("error is null").collect()}
    assert 0 < len(done) <= len(before) < 39
    rows = {r["response_id"]: r for r in complete(df, counting(None), 0.5, retries=0, ledger=ledger, batch=2).collect()}
    assert {i: (r["reply"], r["error"]) for i, r in rows.items()} == {
        i: (None, "nothing to send") if i == 7 else (None, "ValueError: refused") if i == 5 else (t.upper(), None) for i, t in enumerate(texts)}
    assert df.columns[:2] + ["reply", "error"] == complete(df, counting(None), 0.5, retries=0, ledger=ledger).columns
    again = Counter(asked())
    # what was in the ledger was not asked again, and equal prompts are one; failed ones are asked again
    assert sum(again.values()) - len(before) >= 39 - len(before) and again["answer 1"] == 1 and again["answer 5"] >= 2
    known = df.select(prompt_key(F.col("messages"), 0.5).alias("key"), "response").filter(F.col("key").isin(list(done))).collect()
    assert all(again[r["response"]] == 1 for r in known)
    other = complete(df.limit(2), counting(None), 0.7, retries=0, ledger=ledger)  # another temperature is another prompt
    assert other.count() == 2 and sum(Counter(asked()).values()) == sum(again.values()) + 2


def test_tries_wait_longer_and_longer(monkeypatch):
    waits = []
    monkeypatch.setattr(completion.time, "sleep", waits.append)

    def client(messages, temperature):
        raise OSError("busy")

    assert completion._asked(client, [], None, 3, 0.5) == (None, "OSError: busy") and waits == [0.5, 1.0, 2.0]


def model():
    def make_client():
        def client(messages, temperature):
            n = messages[1]["content"].count("\n- ")
            return '{"title": "Théme %d", "insight": "Some", "actions": ["a", "b"]}' % n

        return client

    return make_client


def test_large_clusters_are_merged_over_rounds(spark):
    df = answers(spark, ["word " * 10] * 60).withColumn("cluster", (F.col("response_id") >= 50).cast("int"))
    rows = summarize_clusters(df, "s", "q", model(), part_chars=120).collect()
    assert sorted(row["cluster"] for row in rows) == [0, 1]


def test_survey_end_to_end(spark, tmp_path):
    result = analyze_survey(answers(spark), "Survey", "Why?", model(), k=2, stop_words=["the", "of", "and"])
    clustered = result.clustered.collect()
    assert len(clustered) == len(ANSWERS)
    assert {row["sentiment"] for row in clustered} == {"Positive", "Neutral", "Negative"}
    report = result.report.collect()
    assert [row["cluster"] for row in report] == sorted({row["cluster"] for row in clustered})
    assert report[0]["title"].startswith("Cluster 0 - Th-me ")
    assert report[0]["body"] == "Insights:\nSome\n\nAction Suggestions:\n- a\n- b"
    assert report[0]["keyword_line"].startswith("Top Keywords: ")
    write_report(result.report, str(tmp_path / "text"), "Survey", "Why?")
    lines = "\n".join(row["value"] for row in spark.read.text(str(tmp_path / "text")).collect()).split("\n")
    assert lines[:3] == ["Customer Feedback Analysis Report", "Survey: Survey", "Question: Why?"]
    write_report(result.report, str(tmp_path / "json"), "Survey", "Why?", "json")
    assert spark.read.json(str(tmp_path / "json")).count() == len(report)


def test_row_operators_run_on_a_stream(spark, tmp_path):
    answers(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("response_id long, response string").parquet(str(tmp_path / "in"))
    scored = sentiment.with_sentiment(stream).withColumn("n", F.size(terms(F.col("response"))))
    query = scored.writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("scored").count() == len(ANSWERS)
