"""Spelling variants of words: single edits found by dense prefix-suffix tiles."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textinsight.llm.common import LOWER, UPPER, materialize
from textinsight.session import lookup_join

LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2  # a form is at least so many times as frequent
# A tile has about so many words on a side, and fewer where they are so long that it would exceed CELLS code points.
TILE = 512
CELLS = 1 << 22
_ROWS = 128  # of a tile that are compared with its columns at once

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- dense comparison -------------------------------------------------------------------------


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words in one array, and where each word starts and the last ends."""
    words = words.cast(pa.large_string())
    raw = b"" if words.buffers()[2] is None else bytes(words.buffers()[2])
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = raw[at[0] : at[-1]] if len(at) else b""
    points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
    heads = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return points, heads[at - at[0]] if len(at) else np.zeros(1, np.int64)


def matrices(points: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as columns of padded code points, from their first one on and from their last one back."""
    small = len(points) == 0 or 0 < points.min() and points.max() < 256
    kind, pad = (np.uint8, 0) if small else (np.uint32, 0xFFFFFFFF)
    size = np.diff(starts)
    rows = np.arange(width)[:, None]
    inside = rows < size
    padded = np.append(points, pad).astype(kind)
    last = len(points)
    return (
        padded[np.where(inside, starts[:-1] + rows, last)],
        padded[np.where(inside, starts[1:] - 1 - rows, last)],
    )


def common_run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each column of ``a`` and of ``b``: how many leading rows agree."""
    alive = np.ones((a.shape[1], b.shape[1]), bool)
    run = np.zeros(alive.shape, np.min_scalar_type(2 * len(a)))  # two of these are added
    for x, y in zip(a, b):
        alive &= x[:, None] == y[None, :]
        run += alive
        if not alive.any():
            break
    return run


def single_edits(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], longer: int, share: int, by_prefix: bool,
) -> np.ndarray:
    """Which pairs of two blocks differ by one edit and belong to this kind of bucket.

    The longer word has ``longer`` code points, the other as many or one less. They are one edit apart
    just if common prefix and common suffix reach ``longer - 1`` together. A pair whose common
    prefix has ``share`` code points belongs to the prefix buckets, any other to the suffix buckets.
    """
    prefix = common_run(left[0], right[0])
    suffix = common_run(left[1], right[1])
    return (prefix + suffix >= longer - 1) & ((prefix >= share) == by_prefix)


def _tile_pairs(longer: int, by_prefix: bool, points, starts, run: np.ndarray, home: np.ndarray, whole: np.ndarray):
    """Pairs of row numbers one edit apart, of rows of one bucket and tile (``run``), each pair once."""
    size, count = np.diff(starts), len(run)
    share = longer // 2
    head, tail = matrices(points, starts, longer)
    ends = np.searchsorted(run, run, side="right")  # rows are sorted by run
    at = 0
    while at < count:
        # short runs share a step; a run that is longer than a step meets all columns of its own
        upto = min(at + _ROWS, count)
        stop = int(ends[upto - 1])
        rows, columns = slice(at, upto), slice(at, stop)
        good = single_edits((head[:, rows], tail[:, rows]), (head[:, columns], tail[:, columns]), longer, share, by_prefix)
        i, j = np.nonzero(good)
        i, j = i + at, j + at
        # one of the two has the full length, and they meet in this tile: all of it, or its two sides
        keep = (i < j) & (run[i] == run[j]) & ((size[i] == longer) | (size[j] == longer)) & (whole[i] | (home[i] != home[j]))
        yield i[keep], j[keep]
        at = upto


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``longer, by_prefix, key, i, j, home`` to pairs of near words."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        cut = _last_run(rows)
        held = rows.slice(cut)
        yield from _near(rows.slice(0, cut))
    if held is not None:
        yield from _near(held)


_KEYS = ("longer", "by_prefix", "key", "i", "j")


def _changes(rows: pa.Table, names) -> np.ndarray:
    """Whether each row but the first differs from the one before in any of the columns."""
    change = np.zeros(max(len(rows) - 1, 0), bool)
    for name in names:
        values = rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        change |= values[1:] != values[:-1]
    return change


def _last_run(rows: pa.Table) -> int:
    """Where the last run starts; it may go on in the next batch."""
    return int(np.flatnonzero(np.r_[True, _changes(rows, _KEYS)])[-1]) if len(rows) else 0


def _near(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    run = np.r_[0, np.cumsum(_changes(rows, _KEYS))]
    alone = np.bincount(run)[run] == 1
    rows, run = rows.filter(pa.array(~alone)), run[~alone]
    if not len(rows):
        return
    heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    kinds = np.r_[0, np.cumsum(_changes(rows, _KEYS[:2]))][heads]
    cells = rows.column("longer").to_numpy()[heads] * np.diff(np.r_[heads, len(rows)])
    cuts, held = [0], 0  # runs of one kind share matrices up to CELLS, and a run is whole
    for head, kind, before, more in zip(heads[1:].tolist(), kinds[1:], kinds, cells):
        held += more
        if kind != before or held >= CELLS:
            cuts.append(head)
            held = 0
    for a, b in zip(cuts, [*cuts[1:], len(rows)]):
        part = rows.slice(a, b - a).combine_chunks()
        column = lambda name: part.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        words, n = part.column("word").combine_chunks(), part.column("n").combine_chunks()
        points, starts = code_points(words)
        longer, by_prefix = int(column("longer")[0]), bool(column("by_prefix")[0])
        for i, j in _tile_pairs(longer, by_prefix, points, starts, run[a:b], column("home"), column("i") == column("j")):
            if len(i):
                i, j = pa.array(i), pa.array(j)
                yield pa.RecordBatch.from_arrays(
                    [words.take(i), n.take(i), words.take(j), n.take(j)], names=["a", "n_a", "b", "n_b"])


# --- Spark ------------------------------------------------------------------------------------


def ascii_lower_run(run: Column) -> Column:
    """A-Z of a run in lower case; plain ASCII takes Spark's fast way."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def near_pairs(words: DataFrame, tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """``a, n_a, b, n_b``: all pairs of distinct ``words(word, n)`` one inserted, deleted or replaced code point apart.

    Of two such words, the longer of L code points, the common prefix and suffix have L - 1 code
    points together, so one of the two has L // 2 of them. Every word is filed under the prefix and
    the suffix of that size, once for L its own length and once for one more. Words of a bucket are
    compared in dense tiles: their code points stand in padded matrices, and the common prefix and
    suffix of all pairs of two blocks are counted column by column. A pair with a common prefix of
    L // 2 is taken from its prefix bucket only, any other from its suffix bucket, so each comes out
    once. Buckets are keyed by a hash; words that meet by a clash of hashes fail the same test.

    A bucket of more than ``tile`` words is cut into blocks, and every pair of blocks is a tile of
    its own, so no task meets a whole bucket. Long words make the blocks smaller: a tile has about
    ``cells`` code points on a side at most, or one word.
    """
    length = F.length("word")
    sizes = F.explode(F.array(length, length + 1)).alias("longer")
    halves = F.explode(F.array(F.lit(True), F.lit(False))).alias("by_prefix")
    filed = words.select("word", "n", sizes).select("word", "n", "longer", halves)
    share = F.floor(F.col("longer") / 2).cast("int")
    part = F.when(F.col("by_prefix"), F.substring("word", F.lit(1), share)).otherwise(
        F.substring("word", F.length("word") - share + 1, share))
    # a word shorter than the part cannot have such a partner
    filed = filed.filter(F.length("word") >= share).withColumn("key", F.xxhash64(part))
    bucket = ["longer", "by_prefix", "key"]
    room = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(cells) / F.col("longer")))).cast("int")
    full = filed.groupBy(*bucket).agg(F.count("*").alias("_held")).filter(F.col("_held") > room)
    full = full.select(*bucket, F.ceil(F.col("_held") / room).cast("int").alias("_blocks"))
    dealt = lookup_join(filed, full, bucket, "word", "left")
    home = F.pmod(F.xxhash64("word", F.lit("block")), F.coalesce("_blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))
    dealt = dealt.withColumn("home", home).withColumn("_other", other)
    dealt = dealt.withColumn("i", F.least("home", "_other")).withColumn("j", F.greatest("home", "_other"))
    sorted_tiles = dealt.repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j", "home")
    return sorted_tiles.select(*bucket, "i", "j", "home", "word", "n").mapInArrow(
        _compare, "a string, n_a long, b string, n_b long")


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, form, root``: where following ``forms(word, form)`` ends, by doubling the step each round.

    A form is more frequent than its word by a factor, so there is no circle and the rounds are few.
    """
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        ends = materialize(ends)
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = lookup_join(ends, further, ["root"], "word", "left")
        if moved.filter("_next is not null").isEmpty():
            return forms.join(ends, "word")
        ends = moved.select("word", F.coalesce("_next", "root").alias("root"))


def word_counts(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    long_enough = words.filter(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def spelling_variants(
    words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO,
    tile: int = TILE, cells: int = CELLS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that is long and frequent enough.

    ``words(word)`` has one row per occurrence. Two words are near if they differ by exactly one
    inserted, deleted or replaced code point. ``form`` is the near word of largest count (ties: the
    smallest in code-point order) if that is at least ``ratio`` times the word's own count, else null;
    ``root`` is where following the forms ends, the word itself if it has none. ``n_near`` counts the
    near words and ``form_n`` is the count of the form.

    Nulls are no words. Words of any length are compared whole. An empty table gives no rows.
    """
    counted = materialize(word_counts(words, least_length, least_count))
    pairs = near_pairs(counted, tile, cells)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("word"), F.col("n_a").alias("m"), F.col("a").alias("other")),
    )).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    follows = -F.col("best.m") >= ratio * F.col("n")
    found = materialize(counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(follows, F.col("best.other")).alias("form"), F.when(follows, -F.col("best.m")).alias("form_n")))
    roots = with_roots(found.filter("form is not null").select("word", "form")).drop("form")
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                typo_every: int = 97) -> DataFrame:
    """``word``, one row per maximal run of ``A-Za-z`` and U+00C0 to U+00FF of at least ``least_length``.

    A-Z are lower-cased. Where ``typo_every`` divides the CRC-32 h of ``<id>:<run>``, the code point
    at h modulo the length is deleted. A null text has no runs, a null id counts as the empty text.
    Runs that are shorter can only become shorter, so they are left out at once.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least_length},}})"), F.lit(1))
    one = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    one = one.select("_id", ascii_lower_run(F.col("_run")).alias("_run"))
    drawn = one.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    return drawn.select(F.when(F.col("_h") % typo_every == 0, cut).otherwise(F.col("_run")).alias("word"))
