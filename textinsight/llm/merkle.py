"""Merkle manifest of a table by time-forward processing: one root, and a proof for every row."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textinsight.llm.common import global_rank, materialize
from textinsight.session import lookup_join

# Levels of the tree that one task works through at once: a block is a subtree over 2 ** LEVELS nodes.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"
_MESSAGE = f"subroot string, root string, proof {PROOF}"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hexadecimal SHA-256 of a row's fields, each with its length, so that no two rows read alike."""
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give: level by level, the siblings go left and right of the digest."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Hexadecimal SHA-256 of all siblings of a proof."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


# --- one block: a subtree over consecutive nodes ----------------------------------------------
# A node is (level, index). Its label is (last leaf below it, level), so a node comes after all its children.


def _label(level: int, index: int, leaves: int) -> tuple[int, int]:
    return min((index + 1) << level, leaves) - 1, level


def sweep_up(digests: Sequence[str], levels: int) -> Iterator[tuple[int, int, str]]:
    """``(level, index, digest)`` of every inner node of a subtree, in label order.

    Leaves come in label order. Each node sends its digest to its parent through a queue ordered by
    the label of the receiver. A label that lies before the next leaf has all its messages, so it
    is taken off, worked out and sent on. No more than two messages a level wait at once.
    """
    queue: list[tuple[tuple[int, int], int, str]] = []

    def send(level: int, index: int, digest: str) -> None:
        if level < levels:
            heappush(queue, (_label(level + 1, index >> 1, len(digests)), index, digest))

    for leaf, digest in enumerate(digests):
        send(0, leaf, digest)
        while queue and queue[0][0][0] <= leaf:
            label, first, joined = heappop(queue)
            while queue and queue[0][0] == label:
                joined += heappop(queue)[2]
            node = (label[1], first >> 1, sha256(joined.encode()).hexdigest())
            yield node
            send(*node)


def sweep_down(
    digests: dict[tuple[int, int], str], leaves: int, levels: int, left: list[str], right: list[str],
) -> Iterator[tuple[int, list[str], list[str]]]:
    """``(leaf, left, right)``: the siblings of every leaf and of all above it, by the reversed order of labels.

    The top node holds the siblings from its own level up. Each node takes its message off the
    queue and sends every child the message with that child's sibling before it.
    """
    queue = []

    def send(level: int, index: int, left: list[str], right: list[str]) -> None:
        last, depth = _label(level, index, leaves)
        heappush(queue, ((-last, -depth), level, index, left, right))

    send(levels, 0, left, right)
    while queue:
        _, level, index, left, right = heappop(queue)
        if level == 0:
            yield index, left, right
            continue
        one, two = digests[level - 1, 2 * index], digests.get((level - 1, 2 * index + 1), "")
        send(level - 1, 2 * index, ["", *left], [two, *right])
        if two:
            send(level - 1, 2 * index + 1, [one, *left], ["", *right])


def _height(nodes: int) -> int:
    return (nodes - 1).bit_length()


def _up(levels: int):
    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        group, nodes, number = (k.as_py() for k in key)
        block = block.sort_by("pos")
        height = min(levels, _height(nodes))
        found = list(sweep_up(block.column("digest").to_pylist(), height))
        at, index, digest = zip(*found) if found else ((), (), ())
        many, left = len(found), -(-nodes >> height)  # nodes left of the group where the block ends
        return pa.table({
            "g": pa.array([group] * many, pa.string()), "n": pa.array([nodes] * many, pa.int64()),
            "level": pa.array(at, pa.int32()),
            "pos": pa.array([(number << levels - a) + i for a, i in zip(at, index)], pa.int64()),
            "digest": pa.array(digest, pa.string()), "top": pa.array([a == height for a in at], pa.bool_()),
            "rest": pa.array([left] * many, pa.int64()),
        })

    return run


def _down(levels: int, carry: Sequence[str]):
    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        number = key[-1].as_py()
        level, pos = block.column("level").to_pylist(), block.column("pos").to_pylist()
        text = block.column("digest").to_pylist()
        message = block.slice(level.index(-1), 1).to_pylist()[0]
        digests = {(a, p - (number << levels - a)): d for a, p, d in zip(level, pos, text) if a >= 0}
        row = {p - (number << levels): i for i, (a, p) in enumerate(zip(level, pos)) if a == 0}
        steps = message["proof"]
        leaves = len(row)
        height = max(a for a, _ in digests)  # the block's own top is among its nodes
        order, ends, before, after = [], [0], [], []
        for leaf, left, right in sweep_down(
            digests, leaves, height, [s["left"] for s in steps], [s["right"] for s in steps]):
            order.append(row[leaf])
            before += left
            after += right
            ends.append(len(before))
        proof = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["left", "right"]))
        own = block.select(["g", "pos", "digest", *carry]).take(pa.array(order, pa.int64()))
        for name in ("subroot", "root"):
            own = own.append_column(name, pa.array([message[name]] * len(order), pa.string()))
        return own.append_column("proof", proof)

    return run


# --- a forest of groups, block by block -------------------------------------------------------


def climb(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Sweep up all groups of ``nodes(g, pos, n, digest, ...)``, ``n`` being the nodes of the group.

    Returns the nodes and inner nodes of each round, and ``g, digest, round`` of the groups' roots.
    A round lifts every group by ``levels`` levels; Spark's sorted shuffle brings the messages of a
    block together, and blocks are of one bounded size whatever a group holds.
    """
    rounds, roots = [], None
    block = F.shiftright("pos", levels)
    while True:
        first = not rounds
        done = nodes.filter("n = 1").select("g", "digest", F.lit(max(len(rounds) - 1, 0)).alias("round"))
        roots = done if roots is None else roots.unionByName(done)
        if not first:
            nodes = nodes.filter("n > 1")
            if nodes.isEmpty():
                return rounds, roots
        inner = materialize(
            nodes.select("g", "n", "pos", "digest").groupBy("g", "n", block.alias("block")).applyInArrow(
                _up(levels), "g string, n long, level int, pos long, digest string, top boolean, rest long"))
        rounds.append((nodes, inner))
        nodes = inner.filter("top").select("g", "pos", F.col("rest").alias("n"), "digest")


def descend(
    rounds: list[tuple[DataFrame, DataFrame]], messages: DataFrame, carry: Sequence[str] = (), levels: int = LEVELS,
) -> DataFrame:
    """Sweep down again: ``g, pos, digest, carry..., subroot, root, proof`` of every node of the first round.

    ``messages(g, round, subroot, root, proof)`` holds what the root of each group passes on. Each
    round hands the tops of its blocks the messages that the round above delivered to them.
    """
    sent = None
    for at in range(len(rounds) - 1, -1, -1):
        nodes, inner = rounds[at]
        names = list(carry) if at == 0 else []
        block = F.shiftright("pos", levels).alias("block")
        own = messages.filter(F.col("round") == at).select("g", F.lit(0).cast("long").alias("block"), "subroot", "root", "proof")
        arrived = own if sent is None else own.unionByName(
            sent.select("g", F.col("pos").alias("block"), "subroot", "root", "proof"))
        leaves = nodes.select("g", block, F.lit(0).alias("level"), "pos", "digest", *names)
        # an inner node lies in the block of the nodes below it
        middle = inner.select("g", F.expr(f"shiftright(pos, {levels} - level)").alias("block"), "level", "pos", "digest")
        rows = leaves.unionByName(middle, allowMissingColumns=True).unionByName(
            arrived.withColumn("level", F.lit(-1)), allowMissingColumns=True)
        kinds = "".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}, " for c in names)
        sent = rows.groupBy("g", "block").applyInArrow(
            _down(levels, names), f"g string, pos long, digest string, {kinds}{_MESSAGE}")
        if at:
            sent = materialize(sent)
    return sent


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
    carry: Sequence[Column] = (), levels: int = LEVELS,
) -> DataFrame:
    """``id, group, leaf, subroot, root, proof`` and the ``carry`` columns, one row per document.

    A leaf is the digest of the named fields. The leaves of each group, in the order of their ids, form
    a binary tree whose last node of a level may stand alone; its top is ``subroot``. The subroots,
    ordered by group (null first, then bytewise), form the tree of ``root``. ``proof`` lists, from the
    leaf up, the digests left and right of the path: ``fold_proof`` gives the root again.

    The sweeps are time-forward processing: nodes are labelled so that children come before parents,
    digests travel to parents through a queue ordered by label, and siblings travel back to the leaves
    in the reversed order. The part of the queue that a machine cannot hold is Spark's sorted shuffle
    between blocks of ``2 ** levels`` nodes, so a group may hold any share of the rows and no task
    holds more than a block.

    Nulls are values of their own: a null id comes first, a null group is a group. Rows that repeat an
    id are ordered by their digest; equal rows are interchangeable leaves. An empty table gives no
    rows. Other columns are not read, whatever their names. ``carry`` expressions are worked out on
    the row and must not be named as one of the result's columns.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null sorts first
    leaves = materialize(docs.select(
        F.col(id_col).alias("_id"), group.alias("g"), leaf_digest([F.col(c) for c in fields]).alias("digest"),
        *carry, F.monotonically_increasing_id().alias("_row"),
    ))
    extra = [c for c in leaves.columns if c not in ("_id", "g", "digest", "_row")]
    leaves = leaves.withColumn("_some", F.col("_id").isNotNull())
    ranked = global_rank(leaves, ["g", "_some", "_id", "digest", "_row"], "_rank")
    groups = ranked.groupBy("g").agg(F.count("*").alias("n"), F.min("_rank").alias("_start"))
    nodes = materialize(lookup_join(ranked, groups, ["g"], "_rank").select(
        "g", (F.col("_rank") - F.col("_start")).alias("pos"), "n", "digest", "_id", *extra))

    rounds, tops = climb(nodes, levels)
    tops = materialize(tops)
    total = tops.agg(F.count("*")).first()[0]
    order = global_rank(tops.select("g", "digest", "round"), ["g"], "_rank")
    listed = materialize(order.select(
        F.lit("").alias("g"), F.col("_rank").alias("pos"), F.lit(total).cast("long").alias("n"), "digest",
        F.col("g").alias("_group"), F.col("round").alias("_round")))
    above, root = climb(listed, levels)
    start = root.select(
        "g", "round", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
        F.array().cast(PROOF).alias("proof"))
    messages = materialize(descend(above, start, ["_group", "_round"], levels).select(
        F.col("_group").alias("g"), F.col("_round").alias("round"), F.col("digest").alias("subroot"), "root", "proof"))
    found = descend(rounds, messages, ["_id", *extra], levels)
    name = F.when(F.col("g") != "", F.expr("substring(g, 2)"))
    return found.select(
        F.col("_id").alias(id_col), name.alias(group_col), F.col("digest").alias("leaf"), "subroot", "root", "proof", *extra)
