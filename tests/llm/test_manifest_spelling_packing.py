"""Merkle manifest, spelling variants and packing against brute-force versions, and on edge rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textinsight.llm import merkle, packing, spelling
from textinsight.llm import queries as Q

SF_DIR = "/root/testdata/sf0.001"
# The last columns have names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, id long, g string, pos long, n long, item long, digest string"
EXTRA = ("x", 1, "g", 2, 3, 4, "d")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge_rows():
    long = " ".join(f"word{i % 977} and, of." for i in range(40_000))
    texts = [None, "", " \t\n", "one", "Two  words", "two words", long, long, "ÄÖÜ ñandú", "\0\0"]
    rows = [(i, t, None if i % 4 == 0 else ("é" if i % 5 == 0 else "en"), None if i % 4 == 3 else f"s{i % 2}", None if i % 3 else i) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, "two words", None, None, 7), (None, "b", "en", "s", 8), (3, "other text", "en", None, 1)]


# --- Merkle manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    values = (doc_id, source, lang, n_chars, text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root and the siblings of every node, by plain levels."""
    where, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = nodes[at - at % 2 : at - at % 2 + 2]
            proofs[i].append(("".join(run[: at % 2]), "".join(run[at % 2 + 1 :])))
            where[i] = at // 2
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], proofs


def manifest(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = tree([made[g][0] for g in names])
    out = []
    for g, up in zip(names, above):
        for (_, _, leaf, row), proof in zip(sorted(groups[g], key=lambda x: x[:3]), made[g][1]):
            steps = proof + up
            said = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None:
                said = leaf_of(*row[:4], row[4] + 1)
            folded = said
            for left, right in steps:
                folded = H(left, folded, right)
            out.append((row[0], leaf, made[g][0], root, H(*[a + b for a, b in steps]), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_plain_levels(spark, edge_rows, levels, monkeypatch):
    rows = edge_rows + [(100 + i, f"t{i}", "de", "s", i) for i in range(37)] + [(500, "only", "zz", "s", 1)]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_digest(
        [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS])).alias("claimed")
    found = merkle.merkle_manifest(table(spark, rows), carry=[changed], levels=levels)
    got = found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p"),
        merkle.fold_proof(F.coalesce("claimed", "leaf"), F.col("proof")).alias("f")).collect()
    want = manifest(rows)
    assert sorted([(*r, r.f == r.root) for r in got], key=repr) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.merkle_manifest(table(spark, [(5, "a", "en", None, 1)])).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == leaf_of(5, "a", "en", None, 1) and one[0].proof == []
    assert merkle.merkle_manifest(table(spark, [])).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_sweeps_of_a_block(n):
    leaves = [H(str(i)) for i in range(n)]
    height = (n - 1).bit_length()
    nodes = list(merkle.sweep_up(leaves, height))
    root, proofs = tree(leaves)
    assert (nodes[-1][2] if n > 1 else leaves[0]) == root
    digests = {(0, i): d for i, d in enumerate(leaves)} | {(a, i): d for a, i, d in nodes}
    found = list(merkle.sweep_down(digests, n, height, ["x"], ["y"]))
    assert [leaf for leaf, *_ in found] == list(range(n))[::-1]  # the reversed order of labels
    assert all(list(zip(left, right)) == [*proofs[leaf], ("x", "y")] for leaf, left, right in found)


# --- spelling variants

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(occurrences, least_length=5, least_count=3):
    count = {w: n for w, n in collections.Counter(occurrences).items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile, cells", [(512, 1 << 22), (3, 1 << 22), (512, 30)])
def test_variants_equal_all_pairs(spark, tile, cells):
    draw = random.Random(tile)
    vocabulary = {"".join(draw.choice("abé😀"[: draw.randint(2, 4)]) for _ in range(draw.randint(1, 9))) for _ in range(500)}
    vocabulary |= {"hot" + "".join(p) for p in itertools.product("xyz", repeat=3)}  # one bucket of many words
    words = [w for w in sorted(vocabulary) for _ in range(draw.choice([1, 2, 3, 3, 5, 9, 20, 45]))]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "word string")
    got = spelling.spelling_variants(df, tile=tile, cells=cells).collect()
    want = variants(words)
    assert sorted([(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got], key=repr) == want
    assert any(r[1] and r[1] != r[2] for r in want)  # forms of forms


def test_very_long_words(spark):
    base = "".join(random.Random(1).choices("abcdefgh", k=150_000))
    words = [base, base[:70_000] + "x" + base[70_001:], base[1:], base[:-1] + "q", "x" + base + "x"]
    df = spark.createDataFrame([(w,) for i, w in enumerate(words) for _ in range(3 * 2**i)], "word string")
    got = {(len(r.word), r.n): (r.n_near, r.form_n) for r in spelling.spelling_variants(df, cells=1 << 18).collect()}
    assert [got[len(w), 3 * 2**i] for i, w in enumerate(words)] == [(3, 24), (1, None), (1, None), (1, None), (0, None)]


def test_runs_of_the_query(spark, edge_rows):
    def runs(doc_id, text):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            yield run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run

    rows = [(i, t, *r[2:]) for i, r in enumerate(edge_rows * 2) for t in [r[1] if len(r[1] or "") < 100 else r[1][:3000]]]
    rows += [(10_000 + i, "Überaus ÀÉÿ×÷ straße Straße wordword", None, None, None) for i in range(300)]
    got = spelling.letter_runs(table(spark, rows)).collect()
    want = [w for r in rows for w in runs(*r[:2])]
    assert collections.Counter(r.word for r in got if len(r.word) > 4) == collections.Counter(w for w in want if len(w) > 4)
    assert spelling.spelling_variants(spelling.letter_runs(table(spark, []))).collect() == []
    found = spelling.spelling_variants(spelling.letter_runs(table(spark, rows))).collect()
    assert sorted([tuple(r) for r in found], key=repr) == variants(want)


# --- packing

def squares(lengths, capacity):
    """Every gap tried by the sum it would give."""
    gaps, places = [], []
    for size in lengths:
        best = None
        for gap in sorted(set(g for g in gaps if g >= size)):
            left = list(gaps)
            left.remove(gap)
            left.append(gap - size)
            total = sum(n * n for g, n in collections.Counter(left).items() if g)
            if best is None or total < best[0]:
                best = total, gap
        at = gaps.index(best[1]) if best else len(gaps)
        if best is None:
            gaps.append(capacity)
        places.append(capacity - gaps[at])
        gaps[at] -= size
    return places, sorted(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_squares_equal_trying_every_gap(seed):
    draw = random.Random(seed)
    lengths = sorted((draw.randint(1, 29) for _ in range(80)), reverse=True) if seed % 2 else [draw.randint(1, 29) for _ in range(80)]
    bins, places = packing.sum_of_squares(np.array(lengths), 30)
    want, gaps = squares(lengths, 30)
    assert places.tolist() == want
    assert sorted(30 - sum(s for s, b in zip(lengths, bins) if b == k) for k in set(bins.tolist())) == gaps


@pytest.mark.parametrize("shard", [40, 500, 1 << 15])
def test_packing_is_gapless_and_tight(spark, shard):
    draw = random.Random(3)
    lengths = [min(100, int(draw.expovariate(1 / 25)) + 1) for _ in range(1500)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    rows = packing.pack(items, 100, shard).collect()
    assert sorted(r["item"] for r in rows) == list(range(1500))
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], lengths[r["item"]]))
    for parts in held.values():
        parts.sort()
        assert [at for at, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= 100
    assert len(held) <= -(-sum(lengths) // 100) + (2 if shard > 40 else 1500 // 40)
    if shard == 40:  # no two sequences could be one
        fills = sorted(sum(n for _, n in parts) for parts in held.values())
        assert len(fills) < 2 or fills[0] + fills[1] > 100


def test_words_encode_like_whole_texts():
    encoder = packing.Encoder(TOKENIZER, cache_words=300, part_bytes=50)
    assert encoder.by_word
    draw = random.Random(5)
    units = ["the", "The", "straße", "été", "ÉTÉ", "naïve", "don't", "we'll", "'s", "a'S", ".", ",", "?!", "...", "e.g.", "x,y", "42", "3.5", "½", "ª",
             "é", "́", "̸", "=", "<", " ", " ", "\x1c", "\x85", "\x0b", "\f", "\0", "ΟΔΟΣ", "Σ", "İ", "ﬁ", "K", "日本語", "😀", "<|x|>", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["", " ", "\n\t", "word" * 200, "Some words, of a text. And more! Is it? Yes: it is; ok."]
    texts += ["".join(draw.choice([u, u + " ", " " + u, u + "\n"]) for u in draw.choices(units, k=draw.randint(1, 40))) for _ in range(1500)]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for text in texts:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    other = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    assert np.frombuffer(other.encode(texts[4].encode()), "<u4").tolist() == other.tokenizer.encode(texts[4], add_special_tokens=False).ids


def pieces_of(rows, tokens=2048):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), tokens)):
            part = ids[start : start + tokens]
            out.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def check_packed(rows, want, tokens=2048):
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [at for at, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= tokens
    return len(held)


def test_packing_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = pieces_of([tuple(r) for r in docs.select("doc_id", "text").collect()])
    used = check_packed(Q.op13_sum_of_squares_packing(spark, SF_DIR).collect(), want)
    assert used <= -(-sum(r[3] for r in want) // 2048) + 1


def test_packing_of_edge_rows(spark, edge_rows):
    rows = packing.pack_documents(table(spark, edge_rows), TOKENIZER)
    check_packed(rows.collect(), pieces_of([r[:2] for r in edge_rows]))
    assert packing.pack_documents(table(spark, []), TOKENIZER).collect() == []


def test_sequences_hold_the_documents(spark, edge_rows):
    rows = [r for r in edge_rows if len(r[1] or "") < 100]
    packed = packing.pack_documents(table(spark, rows), TOKENIZER, tokens=8, with_ids=True).cache()
    found = {r["sequence_id"]: r for r in packing.token_sequences(packed).collect()}
    for r in packed.collect():
        assert found[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert sum(len(r["ids"]) for r in found.values()) == sum(p[3] for p in pieces_of([r[:2] for r in rows], 8))
