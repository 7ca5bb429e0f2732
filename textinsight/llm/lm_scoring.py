"""Language model scores by context-tree weighting over bytes, and by smoothed word frequencies."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textinsight.llm.bytegrams import ORDER, PAD, Lookup, contexts, count_grams, strings
from textinsight.llm.common import ascii_lower, blank_words, materialize
from textinsight.session import bucketed, unbucketed

# So many of the most frequent words of so many bytes, and of the most frequent bytes with their contexts, are
# looked up by broadcast; all others by shuffle. The results are the same.
FREQUENT_WORDS = 150_000
FREQUENT_BYTES = 64
FREQUENT_GRAMS = 1_000_000
END = "\0"
_ROWS = 1 << 17  # grams of a subtree worked through at once
_LN2, _LN10 = float(np.log(2)), float(np.log(10))

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- the context tree -------------------------------------------------------------------------
# A gram is a byte with ORDER = 4 bytes of context before it, as one number. A node of the tree is a
# context of 0 to 4 bytes. A byte is eight binary decisions, at the nodes 1 to 255 of a tree of its own.


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function by its asymptotic series, eight steps up."""
    up = np.ones_like(x)
    for i in range(8):
        up *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(up)


def _block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a whole sequence with these counts."""
    out = np.zeros(zeros.shape)
    some = zeros + ones > 0
    a, b = zeros[some], ones[some]
    out[some] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - np.log(np.pi) - _log_gamma(a + b + 1)
    return out


class _Nodes:
    """The decisions of the contexts of one depth: counts, estimate, and weight against the children."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray | None = None) -> None:
        """``split``: log probability of the children's sequences, or ``None`` at the deepest nodes."""
        self.seen = zeros + ones > 0
        self.estimate = (ones + 0.5) / (zeros + ones + 1)
        own = _block(zeros, ones)
        if split is None:
            self.weight, self.weighted = np.ones_like(own), own
        else:
            self.weight = np.exp(np.clip(own - split, -700, 700))
            self.weighted = np.where(self.seen, np.logaddexp(own, split) - _LN2, 0.0)

    def mix(self, at, guess: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The estimates of nodes ``at`` mixed with what deeper nodes say, where those have seen the decision."""
        own, weight, seen = self.estimate[at], self.weight[at], self.seen[at]
        mixed = np.where(known, (weight * own + guess) / (weight + 1), own)
        return np.where(seen, mixed, guess), seen | known


def _decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and outcome of the eight decisions of each byte."""
    step = np.arange(8)
    return (1 << step) | (byte[:, None] >> (8 - step)), (byte[:, None] >> (7 - step)) & 1


class _Subtree:
    """The contexts that end in two given bytes, by the grams of one block of whole third bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        grams = grams.astype(np.int64)
        self.node, self.bit = _decisions(grams & 255)
        third, fourth = grams >> 24 & 255, grams >> 32 & 255
        ones, zeros = (counts[:, None] * x for x in (self.bit, 1 - self.bit))
        deep, self.at4 = np.unique(((fourth << 8 | third) << 8)[:, None] | self.node, return_inverse=True)
        middle, at3 = np.unique(deep & 0xFFFF, return_inverse=True)
        self.at4 = self.at4.reshape(self.node.shape)
        self.fourth = _Nodes(*(np.bincount(self.at4.ravel(), x.ravel(), len(deep)) for x in (zeros, ones)))
        self.at3 = at3[self.at4]
        up = [np.bincount(self.at3.ravel(), x.ravel(), len(middle)) for x in (zeros, ones)]
        self.third = _Nodes(*up, np.bincount(at3, self.fourth.weighted, len(middle)))
        # what the node of two bytes gets from this block
        low = middle & 255
        self.zeros, self.ones = (np.bincount(low, x, 256) for x in up)
        self.split = np.bincount(low, self.third.weighted, 256)

    def mixed(self) -> tuple[np.ndarray, np.ndarray]:
        shape = self.node.shape
        guess, known = self.fourth.mix(self.at4, np.full(shape, 0.5), np.zeros(shape, bool))
        return self.third.mix(self.at3, guess, known)


def _by_third(grams: np.ndarray) -> np.ndarray:
    return np.argsort(grams >> 24 & 255, kind="stable")


def _subtrees(table: pa.Table) -> Iterator[tuple[np.ndarray, _Subtree]]:
    """Blocks of the grams of one two-byte suffix; the contexts of a third byte are never parted."""
    grams, counts = table.column("gram").to_numpy(), table.column("n").to_numpy().astype(float)
    order = _by_third(grams)
    grams, counts = grams[order], counts[order]
    third = grams >> 24 & 255
    at = 0
    while at < len(grams):
        to = int(np.searchsorted(third, third[min(at + _ROWS, len(grams)) - 1], side="right"))
        yield grams[at:to], _Subtree(grams[at:to], counts[at:to])
        at = to


def _second(blocks: list[_Subtree]) -> tuple[np.ndarray, np.ndarray, _Nodes]:
    zeros, ones, split = (sum(getattr(b, name) for b in blocks) for name in ("zeros", "ones", "split"))
    return zeros, ones, _Nodes(zeros, ones, split)


def _lift(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What the contexts that end in two bytes pass on to that of the last of them."""
    zeros, ones, nodes = _second([block for _, block in _subtrees(table)])
    node = np.flatnonzero(nodes.seen)
    return pa.table({
        "byte": np.full(len(node), key[0].as_py() & 255, np.int32), "node": node.astype(np.int32),
        "zeros": zeros[node], "ones": ones[node], "weighted": nodes.weighted[node],
    })


class _Top:
    """The contexts of one byte and of none: at most 256 times 255 decisions and 255."""

    def __init__(self, table: pa.Table) -> None:
        at = table.column("byte").to_numpy() * 256 + table.column("node").to_numpy()
        zeros, ones, split = (np.bincount(at, table.column(c).to_numpy(), 1 << 16) for c in ("zeros", "ones", "weighted"))
        self.first = _Nodes(zeros, ones, split)
        below = [x.reshape(256, 256).sum(0) for x in (zeros, ones, self.first.weighted)]
        self.root = _Nodes(*below)


def _code_lengths(top: _Top):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        last = key[0].as_py() & 255
        blocks = list(_subtrees(table))
        _, _, second = _second([block for _, block in blocks])
        grams, costs = [], []
        for names, block in blocks:
            guess, known = second.mix(block.node, *block.mixed())
            guess, known = top.first.mix(last * 256 + block.node, guess, known)
            guess, known = top.root.mix(block.node, guess, known)
            chance = np.where(known, np.where(block.bit == 1, guess, 1 - guess), 0.5)
            grams.append(names)
            costs.append(np.log(chance).sum(1) / _LN10)
        order = _by_third(table.column("gram").to_numpy())
        return pa.table({"gram": np.concatenate(grams), "n": table.column("n").to_numpy()[order], "cost": np.concatenate(costs)})

    return run


def gram_counts(docs: DataFrame, learn: str = "learn", text_col: str = "text") -> DataFrame:
    """``gram, n``: every byte of all texts with its context, and how often the ``learn`` rows of a batch have it."""
    padded = docs.select(learn, F.concat(F.lit(PAD), F.coalesce(F.col(text_col), F.lit("")), F.lit(END)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted in (True, False):
                rows = batch.filter(pc.equal(batch.column(0), wanted))
                found = count_grams(*strings(rows.column(1))) if rows.num_rows else None
                if found:
                    keys, counts = found
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts * wanted)], names=["gram", "n"])

    return padded.mapInArrow(run, "gram bigint, n bigint")


def code_lengths(grams: DataFrame) -> DataFrame:
    """``gram, n, cost`` of ``grams(gram, n)``: the log10 probability of every gram's byte after its context.

    Frozen context-tree weighting over bytes, each decomposed into eight binary decisions. Every
    context of up to four bytes that training has seen is a node, however rare. At each decision a node weighs
    its own estimate by the Krichevsky-Trofimov probability of all it has seen, against the product of
    the weighted probabilities of its children. A prediction mixes the estimates along the context,
    from the deepest node that has seen the decision up to the root.

    The tree is a Spark table, cut into subtrees by the last two bytes of the context: one pass lifts
    the weights to the 256 contexts of one byte, a second one carries the predictions of the top, a
    table of bounded size, back down to the grams. The counts are summed and bucketed by these two
    bytes in one shuffle.
    """
    spark = grams.sparkSession
    suffix = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("suffix")
    dealt = grams.select(suffix, "gram", "n").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "suffix")
    placed, name = bucketed(dealt.groupBy("suffix", "gram").agg(F.sum("n").alias("n")), ["suffix"], placed=True)
    lifted = placed.groupBy("suffix").applyInArrow(_lift, "byte int, node int, zeros double, ones double, weighted double")
    table = lifted.groupBy("byte", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")])
    top = _Top(table.toArrow())  # at most 256 times 255 rows
    costs = materialize(placed.groupBy("suffix").applyInArrow(_code_lengths(top), "gram long, n long, cost double"))
    unbucketed(spark, name)
    return costs


# --- words ------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, learn: str = "learn", text_col: str = "text") -> DataFrame:
    """``token, c`` of the ``learn`` rows: their words, and one end each."""
    tokens = F.concat(blank_words(ascii_lower(F.col(text_col))), F.array(F.lit(" ")))  # no word has a space
    return docs.filter(learn).select(F.explode_outer(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("c"))


# --- scores -----------------------------------------------------------------------------------


def _frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest counts, whole levels of counts while they are at most ``most`` rows."""
    level = F.floor(F.log2(F.col(count) + 1) * 8)
    least, taken = None, 0
    for row in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred levels
        taken += row["count"]
        if taken > most:
            break
        least = row["level"]
    return table.limit(0) if least is None else table.filter(level >= least)


def _scorer(shared, keep: int):
    """Sums of what is at hand, and a row for every other word and gram of a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lookup, costs = shared.value
        for batch in batches:
            data, offsets = strings(batch.column(keep))
            n = batch.num_rows
            score, total, known, logs = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            rare: list[tuple[np.ndarray, np.ndarray]] = []
            for keys, owner, starts in contexts(data, offsets):
                row = lookup.find(keys)
                score[owner] += np.add.reduceat(np.where(row >= 0, costs[row], 0.0), starts)
                missed = np.flatnonzero(row < 0)
                if len(missed):
                    ends = np.r_[starts[1:], len(keys)]
                    rare.append((np.repeat(owner, ends - starts)[missed], keys[missed]))
            own, tokens, counts = [], [], []
            for i in range(n):
                text = data[offsets[i] + ORDER : offsets[i + 1] - 1].tobytes()
                found = Counter(text.lower().split())  # bytes: A-Z and ASCII white space only
                found[b" "] = 1
                for token, many in found.items():
                    total[i] += many
                    value = words.get(token)
                    if value is None:
                        own.append(i)
                        tokens.append(token)
                        counts.append(many)
                    else:
                        known[i] += many
                        logs[i] += many * value
            mine = [batch.column(k) for k in range(keep)]
            none = lambda size, kind: pa.nulls(size, kind)
            yield _rows(mine, np.arange(n), none(n, pa.string()), none(n, pa.int64()), none(n, pa.int64()),
                        pa.array(total), pa.array(known), pa.array(logs), pa.array(score))
            if tokens:
                size = len(tokens)
                yield _rows(mine, np.array(own), pa.array(tokens, pa.binary()).cast(pa.string()), none(size, pa.int64()), pa.array(counts, pa.int64()))
            if rare:
                owners, keys = (np.concatenate(x) for x in zip(*rare))
                order = np.lexsort((keys, owners))
                owners, keys = owners[order], keys[order]
                heads = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])
                many = np.diff(np.r_[heads, len(keys)])
                yield _rows(mine, owners[heads], none(len(heads), pa.string()), pa.array(keys[heads].astype(np.int64)), pa.array(many, pa.int64()))

    return run


_FOUND = {"token": pa.string(), "gram": pa.int64(), "n": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "logs": pa.float64(), "score": pa.float64()}


def _rows(mine: list[pa.Array], at: np.ndarray, *found: pa.Array) -> pa.RecordBatch:
    """Rows of the documents ``at``; only the first column, the row's number, where they are no sums."""
    at = pa.array(at, pa.int64())
    sums = len(found) == len(_FOUND)
    columns = [c.take(at) if sums or i == 0 else pa.nulls(len(at), c.type) for i, c in enumerate(mine)]
    rest = [*found, *[pa.nulls(len(at), kind) for kind in list(_FOUND.values())[len(found) :]]]
    return pa.RecordBatch.from_arrays([*columns, *rest], names=[f"c{i}" for i in range(len(mine))] + list(_FOUND))


def score_documents(
    docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT_WORDS,
    frequent_grams: int = FREQUENT_GRAMS,
) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``.

    ``train`` is the condition of the rows both models learn from; the others are held out. ``score`` is
    the log10 probability of the bytes of the text and its end by ``code_lengths``. For
    ``base_score`` tokens are the words and one end: a token seen c times among the N training
    tokens, V of them different, scores log10((c + 1) / (N + V + 1)).

    Both models grow with the input: no context and no word is left out. Documents are read once for
    their scores. The values of the most frequent words and grams, of a fixed number, go with the tasks;
    what a document has besides is counted in it and meets its value by a join.

    Null is the empty text, of which only the end is coded. Rows that agree in id and text score alike
    and come out as many times as they came in. Without training rows all bytes are as likely. An
    empty table gives no rows.
    """
    learn = F.coalesce(train, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), learn.alias("learn"), F.col(text_col).alias("text"))
    costs = code_lengths(gram_counts(rows))
    counts = materialize(word_counts(rows))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("train_tokens"), F.count("*").alias("_v"))

    top = _frequent(counts.filter(F.octet_length("token") <= FREQUENT_BYTES), "c", frequent)
    words = {token.encode(): float(np.log10(c + 1)) for token, c in zip(*(x.to_pylist() for x in top.toArrow().columns))}
    best = _frequent(costs, "n", frequent_grams).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(
        (words, Lookup(best.column("gram").to_numpy().astype(np.uint64)), best.column("cost").to_numpy()))

    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    keep = [F.monotonically_increasing_id().alias("c0"), F.col("id").alias("c1"), (~F.col("learn")).alias("c2"), size.alias("c3")]
    padded = rows.select(*keep, F.concat(F.lit(PAD), F.coalesce(F.col("text"), F.lit("")), F.lit(END)).alias("padded"))
    kind = rows.schema["id"].dataType.simpleString()
    found = materialize(padded.mapInArrow(
        _scorer(shared, len(keep)), f"c0 long, c1 {kind}, c2 boolean, c3 long, token string, gram long, n long, "
        "n_tokens long, n_known long, logs double, score double"))

    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    word = found.filter("token is not null").select("c0", "token", "n").join(counts, "token", "left").select(
        "c0", zero.alias("n_tokens"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("n_known"),
        (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("logs"), none.alias("score"))
    gram = found.filter("gram is not null").select("c0", F.col("gram"), F.col("n").alias("many")).join(
        costs.select("gram", "cost"), "gram").select(
        "c0", zero.alias("n_tokens"), zero.alias("n_known"), none.alias("logs"), (F.col("many") * F.col("cost")).alias("score"))
    sums = ["n_tokens", "n_known", "logs", "score"]
    more = word.unionByName(gram).groupBy("c0").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    base = found.filter("n_tokens is not null").select("c0", "c1", "c2", "c3", *sums)
    each = base.join(more, "c0", "left").select(
        "c1", "c2", "c3", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])
    width = F.log10(F.col("train_tokens") + F.col("_v") + 1)
    return each.crossJoin(F.broadcast(totals)).select(
        F.col("c1").alias(id_col), F.col("c2").alias("held_out"), "n_tokens", "n_known", "train_tokens",
        (F.col("logs") - F.col("n_tokens") * width).alias("base_score"), "score", F.col("c3").alias("n_bytes"),
        (-F.col("score") * F.log2(F.lit(10.0)) / (F.col("c3") + 1)).alias("bits_per_byte"),
    )
