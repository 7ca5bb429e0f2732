"""Vector rows, seeding and bounded Lloyd rounds against plain versions."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textinsight.operators import kmeans, tfidf
from textinsight.session import spread

TOPICS = ["red apple pie fruit tree".split(), "fast blue car road wheel".split(), "deep green sea wave fish".split()]


def texts(n=240, seed=1):
    draw = random.Random(seed)
    out = [" ".join(draw.choices(draw.choice(TOPICS), k=draw.randint(1, 6)) + draw.choices([f"word{i}" for i in range(60)], k=draw.randint(0, 7))) for _ in range(n)]
    return out + ["", None, ". !", out[0]]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(list(enumerate(texts())), "response_id long, response string").cache()


@pytest.fixture(scope="module")
def vectors(answers):
    return tfidf.tfidf_vectors(answers, stop_words=[])[0].cache()


def dense(vectors):
    rows = sorted(vectors.collect(), key=lambda r: r["response_id"])
    out = np.zeros((len(rows), 1 + max(max(r["term_ids"], default=0) for r in rows)))
    for i, r in enumerate(rows):
        out[i, list(r["term_ids"])] = list(r["weights"])
    return out


def lloyd(x, starts, max_iter=300, tol=1e-4):
    """Full rounds, every row against every centroid."""
    def assign(c):
        return np.round((c * c).sum(1) - 2 * x @ c.T, 9).argmin(1)

    c = x[starts]
    for _ in range(max_iter):
        labels = assign(c)
        after = np.array([x[labels == j].mean(0) if (labels == j).any() else np.zeros(x.shape[1]) for j in range(len(c))])
        step, c = np.sqrt(((after - c) ** 2).sum(1)).max(), after
        if step <= tol:
            break
    return assign(c), c


@pytest.mark.parametrize("max_rows", [500_000, 0])
def test_vectors_equal_a_plain_count(spark, answers, max_rows):
    rows, dictionary = tfidf.tfidf_vectors(answers, stop_words=["sea"], max_rows=max_rows, with_terms=True)
    numbered = {r["term"]: (r["term_id"], r["df"]) for r in dictionary.collect()}
    assert sorted(i for i, _ in numbered.values()) == list(range(len(numbered)))
    counts = [Counter(w for w in (t or "").replace(".", " ").replace("!", " ").split() if w != "sea") for t in texts()]
    df = Counter(w for c in counts for w in c)
    assert {t: n for t, (_, n) in numbered.items()} == df
    got = {r["response_id"]: r for r in rows.collect()}
    assert sorted(got) == list(range(len(counts)))
    for i, c in enumerate(counts):
        raw = {w: n * (math.log((1 + len(counts)) / (1 + df[w])) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want = {numbered[w][0]: (w, c[w], round(v / norm, 12)) for w, v in raw.items()}
        r = got[i]
        assert {t: (w, n, round(v, 12)) for t, w, n, v in zip(r["term_ids"], r["terms"], r["tfs"], r["weights"])} == want


def test_only_rare_terms_are_joined(spark, monkeypatch):
    """A dictionary too large to broadcast: its common terms are looked up. Ids repeat or are null, rows stay apart."""
    rows = [(i // 2 if i else None, f"sea sea wave w{i} " + ("car" if i % 3 else "w1")) for i in range(60)] + [(7, ""), (None, None)]
    df = spark.createDataFrame(rows, "response_id long, response string")
    met, join = [], tfidf.term_join
    monkeypatch.setattr(tfidf, "term_join", lambda pairs, *rest: met.append(pairs.count()) or join(pairs, *rest))

    def result(max_rows):
        found = tfidf.tfidf_vectors(df, stop_words=[], max_rows=max_rows, with_terms=True)[0].collect()
        return sorted(repr((r[0], sorted(zip(r["terms"], r["tfs"], (round(w, 12) for w in r["weights"]))))) for r in found)

    whole = result(500_000)
    assert met == [] and len(whole) == len(rows)
    assert result(10) == whole and met == [59]  # w0, w2, ... w59: one each
    assert result(0) == whole


def test_vectors_take_no_window_and_no_shuffle_by_document(answers):
    rows, _ = tfidf.tfidf_vectors(answers, stop_words=[])
    plan = rows._jdf.queryExecution().toString()
    assert "Window" not in plan and "hashpartitioning(response_id" not in plan


@pytest.mark.parametrize("k, max_bytes", [(1, 1 << 26), (3, 1 << 26), (6, 1 << 26), (3, 0)])
def test_bounded_rounds_equal_full_rounds(vectors, k, max_bytes):
    x = dense(vectors)
    starts = list(range(0, 5 * k, 5))
    looked = []
    rounds = 300 if max_bytes else 3  # the path by tables takes several jobs a round
    got = kmeans.lloyd_vectors(
        vectors, kmeans.centroids_from_documents(vectors, starts), k, max_iter=rounds, max_bytes=max_bytes, looked=looked).collect()
    want, _ = lloyd(x, starts, rounds)
    assert [r["cluster"] for r in sorted(got, key=lambda r: r["response_id"])] == want.tolist()
    assert looked[0] == len(x) and (max_bytes == 0 or k == 1 or min(looked) < len(x)), looked


def test_a_short_table_of_centroids_is_looked_up(vectors, monkeypatch):
    """Centroids of a few documents take no join, however many terms the rows have; more take one for rare terms."""
    x, starts, joined = dense(vectors), [0, 5, 10], []
    first = kmeans.centroids_from_documents(vectors, starts)
    pairs = kmeans._pairs
    monkeypatch.setattr(kmeans, "_pairs", lambda *args: joined.append(1) or pairs(*args))
    rows, k = first.count(), len(starts)
    want = np.round((x[starts] ** 2).sum(1) - 2 * x @ x[starts].T, 9).argmin(1).tolist()
    for room, joins in ((rows, 0), (10, 1), (0, 1)):
        joined.clear()
        got = kmeans.TableModel(first, k, "response_id", room * 8 * (k + 1)).score(vectors.select("response_id", "term_ids", "weights"))
        assert [r["cluster"] for r in sorted(got.collect(), key=lambda r: r["response_id"])] == want
        assert len(joined) == joins


def test_signed_changes_equal_a_full_update(vectors):
    """Rows that move change the sums as much as working them out anew does, on both paths."""
    x, starts = dense(vectors), [0, 5, 10]
    after = np.array([x[20], x[31], x[42]])
    first = kmeans.centroids_from_documents(vectors, starts)
    for max_bytes in (1 << 26, 0):
        model = kmeans.model_of(first, 3, "response_id", x.shape[1], max_bytes)
        reference = model.score(vectors.select("response_id", "term_ids", "weights")).cache()
        sums, sizes, rows = model.sums(reference, relabel=False)
        later = kmeans.model_of(kmeans.centroids_from_documents(vectors, [20, 31, 42]), 3, "response_id", x.shape[1], max_bytes)
        change, moved, looked = later.sums(reference, relabel=True)
        labels = np.round((after**2).sum(1) - 2 * x @ after.T, 9).argmin(1)
        want = np.array([x[labels == j].sum(0) for j in range(3)])
        got = np.zeros_like(want)
        for r in sums.plus(change).table(vectors.sparkSession).collect():
            got[:, r["term_id"]] = r["c"]
        assert np.allclose(got, want, atol=1e-9) and rows == looked == len(x)
        assert np.round(sizes + moved).tolist() == [(labels == j).sum() for j in range(3)]


def test_a_round_leaves_out_what_its_bounds_rule_out(vectors):
    """A row whose margin exceeds the way of the centroids keeps its nearest one."""
    x = dense(vectors)
    draw = np.random.default_rng(2)
    c = draw.random((4, x.shape[1])) * 0.2
    later = c + draw.normal(0, 0.004, c.shape)
    drift = np.sqrt(((later - c) ** 2).sum(1))
    model = kmeans.ArrayModel(c.T.copy())
    reference = model.score(vectors.select("response_id", "term_ids", "weights")).cache()
    near = {r["response_id"] for r in kmeans._failing(reference, drift).collect()}
    assert 0 < len(near) < len(x)
    for r in reference.collect():
        now = ((x[r["response_id"]] - later) ** 2).sum(1).argmin()
        assert r["response_id"] in near or now == r["cluster"]


def test_seeds_take_a_fixed_number_of_passes(vectors, monkeypatch):
    passes = []
    score = kmeans.ArrayModel.score
    monkeypatch.setattr(kmeans.ArrayModel, "score", lambda self, rows: passes.append(1) or score(self, rows))
    found = {}
    for k in (2, 6):
        passes.clear()
        found[k] = kmeans.seed_documents(vectors, k)
        assert len(passes) == kmeans.PASSES + 1 and len(set(found[k])) == k
    x = dense(vectors)
    apart = ((x[found[6]][:, None] - x[found[6]][None]) ** 2).sum(2)
    assert (apart + np.eye(6) > 0.1).all()  # no two of them alike
    assert kmeans.seed_documents(vectors, 6, max_bytes=0) == found[6]


def test_fewer_distinct_rows_than_clusters(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a1 b2", "c3", "a1 b2", "", None])], "response_id long, response string")
    got = {r["response_id"]: r["cluster"] for r in kmeans.kmeans_cluster(df, 5, stop_words=[]).collect()}
    assert len(got) == 5 and got[0] == got[2] != got[1] and len(set(got.values())) == 2


def test_spread_leaves_enough_partitions_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, 1, cores)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 1000, 1, 1), "id").rdd.getNumPartitions() == cores


@pytest.mark.parametrize("max_bytes, tables", [(kmeans.BROADCAST_BYTES, 2), (0, 5)])
def test_few_tables_are_left(spark, answers, max_bytes, tables, monkeypatch):
    folders = []

    def noted(write):
        def call(df):
            table = write(df)
            folders.append(os.path.dirname(table.inputFiles()[0]).removeprefix("file://"))
            return table
        return call

    for module in (kmeans, tfidf):
        monkeypatch.setattr(module, "written", noted(module.written))
    found = kmeans.lloyd_kmeans(answers, 3, max_iter=2, stop_words=[], start_ids=[0, 1, 2], max_bytes=max_bytes)
    assert found.count() == answers.count()
    # the rows, the reference, and where centroids are tables the sums and at most two sets of centroids
    assert sum(os.path.isdir(folder) for folder in folders) <= tables < len(folders)
