"""K-means over sparse TF-IDF rows, for any number of rows and terms."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, cut_lineage, discard, reclaim, small_side, written
from .tfidf import HOT_SALTS, HOT_SHARE, raw_vectors, resolve_stop_words, unit_weights

# Costs of a row against two centroids are rounded before they are compared.
SCORE_DIGITS = 9
# Two distances further apart than this cannot be a tie after rounding.
CLEAR = 1e-4
# Seeding: passes over the rows, and rows drawn in each per cluster.
PASSES, OVERSAMPLE = 2, 2
# The bounds are taken anew when so much of the rows fails them and the last step was half the way since.
FAILED_SHARE = 0.25

# vectors(id, term_ids, weights): one row per document. centroids(term_id, c): the weight of a term in each cluster.
# Written rows may hold (raw, square) for the weights, which takes less room; ``_weighted`` works them out.


def _weighted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("weights", unit_weights()) if "raw" in rows.columns else rows


def _let_go(shared: list) -> None:
    """Delete copies of an array from the disks of driver and executors; the tasks that read it are done."""
    while shared:
        shared.pop().destroy()


def centroids_from_documents(vectors: DataFrame, ids: Sequence, id_col: str = "response_id") -> DataFrame:
    """Centroids that are the TF-IDF rows of the given documents, in that order."""
    entries = F.explode(F.arrays_zip("term_ids", "weights")).alias("_e")
    chosen = vectors.filter(F.col(id_col).isin(list(ids))).select(id_col, entries).select(
        id_col, F.col("_e.term_ids").alias("term_id"), "_e.weights")
    weights = [F.coalesce(F.max(F.when(F.col(id_col) == i, F.col("weights"))), F.lit(0.0)) for i in ids]
    return chosen.groupBy("term_id").agg(F.array(*weights).alias("c"))


def _scored(vectors: DataFrame, costs: Column) -> DataFrame:
    """``cluster, cost, margin`` from the costs against every centroid; see ``assign_to_centroids``."""
    least = F.array_min("_costs")
    own = F.aggregate("weights", F.lit(0.0), lambda total, w: total + w * w)
    cluster = (F.array_position("_costs", F.col("cost")) - 1).cast("int")

    def distance(cost: Column) -> Column:
        return F.sqrt(F.greatest(cost + F.col("_own"), F.lit(0.0)))

    others = F.filter("_costs", lambda cost, i: i != F.col("cluster"))
    names = [c for c in vectors.columns if c not in ("cluster", "cost", "margin", "_dots")]
    return (
        vectors.withColumn("_costs", costs).withColumn("cost", least).withColumn("_own", own).withColumn("cluster", cluster)
        .select(*names, "cluster", "cost", F.coalesce(distance(F.array_min(others)) - distance(F.col("cost")), F.lit(math.inf)).alias("margin"))
    )


class ArrayModel:
    """Centroids as an array that every task holds: for as many terms and clusters as fit ``BROADCAST_BYTES``.

    Row t of ``values`` holds the weights of the term with id t.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.k, self.shared = values, values.shape[1], []

    @classmethod
    def read(cls, centroids: DataFrame, k: int, n_terms: int) -> ArrayModel:
        table = centroids.toArrow()  # bounded by the check in ``model_of``
        values = np.zeros((n_terms, k))
        values[table.column("term_id").to_numpy()] = table.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return cls(values)

    def score(self, vectors: DataFrame) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((self.values, (self.values**2).sum(0)))
        self.shared.append(shared)
        names = vectors.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, norms = shared.value
            for batch in batches:
                dots = _dots(batch.column("term_ids"), batch.column("weights"), values)
                costs = np.round(norms - 2 * dots, SCORE_DIGITS)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(costs.ravel()), costs.shape[1]).cast(pa.list_(pa.float64()))],
                    names=[*names, "_dots"])

        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in vectors.schema)
        return _scored(vectors.mapInArrow(run, f"{kinds}_dots array<double>"), F.col("_dots"))

    def sums(self, labelled: DataFrame, relabel: bool) -> tuple[ArrayModel, np.ndarray, int]:
        """Sums of the rows of each cluster, sizes, and how many rows were looked at.

        With ``relabel`` the rows' clusters are compared with those under these centroids, and the
        sums are signed: a row that moves leaves one cluster and joins another, any other adds nothing.
        """
        k = self.k
        shared = labelled.sparkSession.sparkContext.broadcast((self.values if relabel else None, (self.values**2).sum(0)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, norms = shared.value
            for batch in batches:
                ids, weights = batch.column("term_ids"), batch.column("weights")
                before = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.arange(len(before))
                sign = np.zeros((len(before), k))
                if relabel:
                    now = np.round(norms - 2 * _dots(ids, weights, values), SCORE_DIGITS).argmin(1)
                    sign[row, now] += 1
                    sign[row, before] -= 1
                else:
                    sign[row, before] = 1
                found, changes = _signed_sums(ids, weights, sign)
                # sizes and the number of rows travel as one term more
                sums = [np.r_[sign[:, j].sum(), change] for j, change in enumerate(changes)]
                looked = np.zeros(len(found) + 1, np.int64)
                looked[0] = len(before)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[-1, found]), pa.array(looked), *map(pa.array, sums)],
                    names=["term_id", "looked", *[f"s{j}" for j in range(k)]])

        shape = "term_id bigint, looked bigint, " + ", ".join(f"s{j} double" for j in range(k))
        parts = labelled.select("term_ids", "weights", "cluster").mapInArrow(run, shape)
        table = parts.groupBy("term_id").agg(*[F.sum(c).alias(c) for c in parts.columns[1:]]).toArrow()
        _let_go([shared])
        terms = table.column("term_id").to_numpy()
        found = np.column_stack([table.column(f"s{j}").to_numpy() for j in range(k)]) if len(terms) else np.zeros((0, k))
        own = terms >= 0
        total = np.zeros(self.values.shape)
        total[terms[own]] = found[own]
        return ArrayModel(total), found[~own].sum(0), int(table.column("looked").to_numpy().sum())

    def release(self) -> None:
        """Call it when the rows scored so far have been written or collected."""
        _let_go(self.shared)

    def drop(self) -> None:
        """Call it when nothing reads the centroids any more."""
        self.release()

    def plus(self, change: ArrayModel) -> ArrayModel:
        return ArrayModel(self.values + change.values)

    def means(self, sizes: np.ndarray) -> ArrayModel:
        return ArrayModel(self.values * np.where(sizes > 0, 1 / np.maximum(sizes, 1), 0))

    def apart(self, other: ArrayModel) -> np.ndarray:
        """How far each centroid is from the other model's."""
        return np.sqrt(((self.values - other.values) ** 2).sum(0))

    def table(self, spark) -> DataFrame:
        values = pa.FixedSizeListArray.from_arrays(pa.array(self.values.ravel()), self.k).cast(pa.list_(pa.float64()))
        table = spark.createDataFrame(pa.table({"term_id": pa.array(np.arange(len(self.values)), pa.int64()), "c": values}))
        return table.filter(F.exists("c", lambda w: w != 0))


def _owners(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _dots(ids: pa.ListArray, weights: pa.ListArray, values: np.ndarray) -> np.ndarray:
    """Products of every row with every column of ``values``."""
    each = weights.flatten().to_numpy(zero_copy_only=False)[:, None] * values[ids.flatten().to_numpy(zero_copy_only=False)]
    owner = _owners(ids)
    return np.stack([np.bincount(owner, each[:, j], len(ids)) for j in range(values.shape[1])], 1)


def _some_dots(ids: pa.ListArray, weights: pa.ListArray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The part of the products that the terms ``known``, ascending, make up; ``values`` has a row for each."""
    terms = ids.flatten().to_numpy(zero_copy_only=False)
    at = np.searchsorted(known, terms)
    hit = np.flatnonzero(np.r_[known, -1][at] == terms)
    owner = _owners(ids)[hit]
    weight = weights.flatten().to_numpy(zero_copy_only=False)[hit]
    return np.stack([np.bincount(owner, weight * values[at[hit], j], len(ids)) for j in range(values.shape[1])], 1)


def _signed_sums(ids: pa.ListArray, weights: pa.ListArray, sign: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The terms of the rows that have a sign, and the sums of their signed weights in each cluster."""
    owner = _owners(ids)
    moved = np.flatnonzero(sign.any(1)[owner])
    found, at = np.unique(ids.flatten().to_numpy(zero_copy_only=False)[moved], return_inverse=True)
    change = weights.flatten().to_numpy(zero_copy_only=False)[moved, None] * sign[owner[moved]]
    return found, [np.bincount(at, change[:, j], len(found)) for j in range(sign.shape[1])]


class TableModel:
    """Centroids as a table ``(term_id, c)``, for any number of terms.

    The weights of the terms with the lowest ids, the most common ones, are looked up in every task, as many
    as ``max_bytes`` allows. Pairs with other terms join the table, hot ones salted; there are none where the
    table is short, such as that of a few documents.
    """

    def __init__(self, centroids: DataFrame, k: int, id_col: str, max_bytes: int = BROADCAST_BYTES, owned: bool = False) -> None:
        self.centroids, self.k, self.id_col, self.max_bytes = centroids, k, id_col, max_bytes
        self.owned, self.shared = owned, []  # owned: a table of ``written``, deleted by ``drop``

    def _zeros(self) -> Column:
        return F.array(*[F.lit(0.0)] * self.k)

    def _near(self, vectors: DataFrame, known: DataFrame) -> DataFrame:
        """The rows with ``_near``, their products as far as the terms ``known`` make them up."""
        table = known.orderBy("term_id").toArrow()  # bounded by the caller
        values = table.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.k)
        shared = vectors.sparkSession.sparkContext.broadcast((table.column("term_id").to_numpy(), values))
        self.shared.append(shared)
        k, names = self.k, vectors.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dots = _some_dots(batch.column("term_ids"), batch.column("weights"), *shared.value)
                products = pa.FixedSizeListArray.from_arrays(pa.array(dots.ravel()), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, products], names=[*names, "_near"])

        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in vectors.schema)
        return vectors.mapInArrow(run, f"{kinds}_near array<double>")

    def _costs(self, vectors: DataFrame) -> DataFrame:
        squares = [F.coalesce(F.sum(F.col("c")[j] * F.col("c")[j]), F.lit(0.0)) for j in range(self.k)]
        norms = self.centroids.agg(F.array(*squares).alias("norms")).scalar()
        room = self.max_bytes // 8 // (self.k + 1)
        if self.centroids.count() <= room:
            costs = [F.round(norms[j] - 2 * F.col("_near")[j], SCORE_DIGITS) for j in range(self.k)]
            return self._near(vectors, self.centroids).withColumn("_dots", F.array(*costs)).drop("_near")
        rare = F.col("term_id") >= room
        rows = _pairs(vectors.select(self.id_col, "term_ids", "weights"), [self.id_col]).filter(rare)
        total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
        hot = cut_lineage(rows.groupBy("term_id").count().filter(F.col("count") >= HOT_SHARE * total).select("term_id"))
        flagged = F.broadcast(hot.withColumn("_hot", F.lit(True)))  # at most 1 / HOT_SHARE rows
        left = rows.join(flagged, "term_id", "left").withColumn(
            "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(self.id_col), F.lit(HOT_SALTS))).otherwise(F.lit(0)))
        salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
        right = self.centroids.filter(rare).join(flagged, "term_id", "left").withColumn("_salt", F.explode(salts.cast("array<bigint>")))
        met = left.drop("_hot").join(right.drop("_hot"), ["term_id", "_salt"])
        dots = met.groupBy(self.id_col).agg(F.array(*[F.sum(F.col("weight") * F.col("c")[j]) for j in range(self.k)]).alias("_dots"))
        costs = [F.round(norms[j] - 2 * (F.col("_near")[j] + F.coalesce(F.col("_dots")[j], F.lit(0.0))), SCORE_DIGITS) for j in range(self.k)]
        near = self._near(vectors, self.centroids.filter(~rare))
        if "raw" in vectors.columns:  # so the weights are not shuffled
            near = near.drop("weights")
        return _weighted(near.join(dots, self.id_col, "left").withColumn("_dots", F.array(*costs)).drop("_near"))

    def score(self, vectors: DataFrame) -> DataFrame:
        return _scored(self._costs(vectors), F.col("_dots"))

    def sums(self, labelled: DataFrame, relabel: bool) -> tuple[TableModel, np.ndarray, int]:
        looked = labelled.count()
        rows = labelled
        if relabel:  # a row that stays has no sign at all, so it goes no further
            now = self.score(labelled.withColumnRenamed("cluster", "_before")).filter("cluster <> _before")
            rows = written(now.select("term_ids", "weights", "_before", "cluster"))
            self.release()
        signs = [(F.when(F.col("cluster") == j, 1.0).otherwise(0.0) - (F.when(F.col("_before") == j, 1.0).otherwise(0.0) if relabel else 0.0)) for j in range(self.k)]
        signed = rows.select("term_ids", "weights", F.array(*signs).alias("_sign"))
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sign = batch.column("_sign").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                found, sums = _signed_sums(batch.column("term_ids"), batch.column("weights"), sign)
                yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], names=["term_id", *[f"s{j}" for j in range(k)]])

        parts = signed.mapInArrow(run, "term_id bigint, " + ", ".join(f"s{j} double" for j in range(k)))
        total = parts.groupBy("term_id").agg(F.array(*[F.sum(f"s{j}") for j in range(k)]).alias("c"))
        sums = TableModel(written(total), self.k, self.id_col, self.max_bytes, owned=True)
        counted = signed.agg(*[F.sum(F.col("_sign")[j]).alias(f"s{j}") for j in range(self.k)]).first()
        if relabel:
            discard(rows)
        return sums, np.array([counted[f"s{j}"] or 0.0 for j in range(self.k)]), looked

    def release(self) -> None:
        """Call it when the rows scored so far have been written or collected."""
        _let_go(self.shared)

    def drop(self) -> None:
        """Call it when nothing reads the centroids any more."""
        self.release()
        if self.owned:
            discard(self.centroids)

    def plus(self, change: TableModel) -> TableModel:
        return self._combined(change, lambda a, b: a + b)

    def _combined(self, other: TableModel, combine) -> TableModel:
        right = other.centroids.select("term_id", F.col("c").alias("_other"))
        both = self.centroids.join(right, "term_id", "full").select(
            "term_id", F.zip_with(F.coalesce("c", self._zeros()), F.coalesce("_other", self._zeros()), combine).alias("c"))
        return TableModel(both, self.k, self.id_col, self.max_bytes)

    def means(self, sizes: np.ndarray) -> TableModel:
        factors = [float(1 / n) if n > 0 else 0.0 for n in sizes]
        means = self.centroids.select("term_id", F.array(*[F.col("c")[j] * F.lit(f) for j, f in enumerate(factors)]).alias("c"))
        return TableModel(written(means), self.k, self.id_col, self.max_bytes, owned=True)

    def apart(self, other: TableModel) -> np.ndarray:
        change = self._combined(other, lambda a, b: a - b).centroids
        row = change.agg(*[F.coalesce(F.sum(F.col("c")[j] * F.col("c")[j]), F.lit(0.0)).alias(f"s{j}") for j in range(self.k)]).first()
        return np.sqrt(np.array([row[f"s{j}"] for j in range(self.k)]))

    def table(self, spark) -> DataFrame:
        return self.centroids


def _pairs(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., term_id, weight)`` of sparse rows: numbers only."""
    entry = F.explode(F.arrays_zip("term_ids", "weights")).alias("_e")
    return vectors.select(*keys, entry).select(*keys, F.col("_e.term_ids").alias("term_id"), F.col("_e.weights").alias("weight"))


def model_of(
    centroids: DataFrame, k: int, id_col: str, n_terms: int, max_bytes: int = BROADCAST_BYTES,
) -> ArrayModel | TableModel:
    """The centroids as an array where ``n_terms``, the number of term ids, allows it, else as a table.

    The results are the same.
    """
    if n_terms * (k + 1) * 8 <= max_bytes:
        return ArrayModel.read(centroids, k, n_terms)
    return TableModel(written(centroids), k, id_col, max_bytes, owned=True)


def assign_to_centroids(
    vectors: DataFrame, centroids: DataFrame, k: int, id_col: str = "response_id", max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, cluster, cost, margin)``: the nearest centroid of each document, ties to the lowest id.

    A document without terms is a zero row and goes to the centroid of least norm. ``cost`` is the
    squared distance less the squared norm of the document, ``margin`` how much further the second
    nearest centroid is.
    """
    model = model_of(centroids, k, id_col, count_terms(vectors), max_bytes)
    return model.score(vectors.select(id_col, "term_ids", "weights")).select(id_col, "cluster", "cost", "margin")


def update_centroids(
    vectors: DataFrame, labels: DataFrame, k: int, id_col: str = "response_id", max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Mean TF-IDF row of each cluster; documents without terms count as zero rows."""
    labelled = vectors.select(id_col, "term_ids", "weights").join(labels.select(id_col, "cluster"), id_col)
    none = vectors.sparkSession.createDataFrame([], "term_id long, c array<double>")
    sums, sizes, _ = model_of(none, k, id_col, count_terms(vectors), max_bytes).sums(labelled, relabel=False)
    return sums.means(sizes).table(vectors.sparkSession)


def count_terms(vectors: DataFrame) -> int:
    """How many dense term ids the rows can have."""
    return (vectors.agg(F.max(F.array_max("term_ids"))).first()[0] or 0) + 1


def centroid_rows(centroids: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Centroids as ``(cluster, term, weight)`` without the zeros."""
    rows = centroids.select("term_id", F.posexplode("c").alias("cluster", "weight")).filter(F.col("weight") != 0)
    return rows.join(dictionary.select("term_id", "term"), "term_id").select("cluster", "term", "weight")


# --- seeding ----------------------------------------------------------------------------------


def _draw(step: int, seed: int, id_col: str) -> Column:
    """A number in (0, 1] from the MD5 of step and id, so that it does not depend on the partitions."""
    digest = F.md5(F.concat(F.lit(f"{seed + step}:"), F.col(id_col).cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 1) / float(1 << 52)


def seed_documents(
    vectors: DataFrame, k: int, seed: int = 42, id_col: str = "response_id", max_bytes: int = BROADCAST_BYTES,
) -> list:
    """Up to k documents to start from, far from each other, in ``PASSES`` + 2 passes whatever k is.

    k-means++ by oversampling: the first candidate is drawn at random, then each pass draws
    ``OVERSAMPLE * k`` documents at once, with probabilities in proportion to the squared distance to
    the nearest candidate so far. Candidates are weighted by the documents they are nearest to, and
    k-means++ among the weighted candidates, a few numbers, picks the seeds. Draws are races: the
    smallest -ln(u) / weight wins, ties the smallest id.
    """
    some = vectors.filter(F.size("term_ids") > 0).select(id_col, "term_ids", "weights")
    first = some.agg(F.min_by(id_col, F.struct((-F.log(_draw(0, seed, id_col))).alias("time"), id_col)).alias("id")).first()["id"]
    if first is None:
        return []
    candidates, n_terms = [first], count_terms(some)
    own = F.aggregate("weights", F.lit(0.0), lambda total, w: total + w * w)
    far = F.round(F.col("cost") + own, SCORE_DIGITS - 1)

    def model() -> ArrayModel | TableModel:
        return model_of(centroids_from_documents(some, candidates, id_col), len(candidates), id_col, n_terms, max_bytes)

    for step in range(1, PASSES + 1):
        near = model()
        race = near.score(some).withColumn("far", far).filter("far > 0").select(
            id_col, (-F.log(_draw(step, seed, id_col)) / F.col("far")).alias("time"))
        candidates += [row[0] for row in race.orderBy("time", id_col).limit(OVERSAMPLE * k).collect()]  # bounded by k
        near.drop()
    near = model()
    nearest = near.score(some).groupBy("cluster").count().collect()  # one row per candidate
    near.drop()
    weight = dict.fromkeys(range(len(candidates)), 0) | {row["cluster"]: row["count"] for row in nearest}
    apart = _distances(some, candidates, id_col)
    # the draws of the last steps, by candidate
    steps = [_draw(PASSES + 1 + s, seed, id_col).alias(f"u{s}") for s in range(k)]
    draws = {row[id_col]: row for row in some.filter(F.col(id_col).isin(candidates)).select(id_col, *steps).collect()}
    chosen: list[int] = []
    for step in range(k):
        mass = {c: w * (min(apart[c][s] for s in chosen) if chosen else 1.0) for c, w in weight.items()}
        race = [(-math.log(draws[candidates[c]][f"u{step}"]) / m, candidates[c], c) for c, m in mass.items() if m > 0]
        if not race:  # fewer distinct rows than k
            break
        chosen.append(min(race)[2])
    return [candidates[c] for c in chosen]


def _distances(vectors: DataFrame, ids: list, id_col: str) -> list[list[float]]:
    """Squared distances between a few documents."""
    rows = {r[id_col]: dict(zip(r["term_ids"], r["weights"])) for r in vectors.filter(F.col(id_col).isin(ids)).collect()}

    def square(a: dict, b: dict) -> float:
        return sum((a.get(t, 0.0) - b.get(t, 0.0)) ** 2 for t in sorted(a.keys() | b.keys()))

    return [[round(square(rows[i], rows[j]), SCORE_DIGITS - 1) for j in ids] for i in ids]


# --- Lloyd rounds -----------------------------------------------------------------------------


def _failing(reference: DataFrame, drift: np.ndarray) -> DataFrame:
    """Rows of the reference whose bound fails: their nearest centroid may be another one by now.

    A centroid that moved by d changes a distance by at most d. A row keeps its cluster while its margin
    exceeds the way of its own centroid plus the longest way of another. The margins are columns of
    a written table, each file sorted by them, so a scan leaves out what the bounds rule out.
    """
    bounds = []
    for j, own in enumerate(drift):
        other = max([d for i, d in enumerate(drift) if i != j], default=0.0)
        bounds.append((F.col("cluster") == j) & (F.col("margin") <= float(own + other + CLEAR)))
    return reference.filter(reduce(lambda a, b: a | b, bounds))


def lloyd_vectors(
    vectors: DataFrame, centroids: DataFrame, k: int, max_iter: int = 300, tol: float = 1e-4,
    id_col: str = "response_id", max_bytes: int = BROADCAST_BYTES, looked: list | None = None,
) -> DataFrame:
    """``(id, cluster)`` by Lloyd rounds from the given centroids, the same as full rounds give.

    The first round writes a reference: each row with its cluster and its margin. From then on a round reads
    only the rows whose bound fails, and only those that left their cluster of the reference change
    the sums, as signed differences. When too many rows fail, the reference is taken anew. Nothing but the
    reference and the centroids is carried from round to round, so a lost executor costs its tasks.

    Stops after ``max_iter`` updates or when no centroid moves by more than ``tol``. ``looked``
    receives how many rows each round read. What a round no longer needs is deleted at once.
    """
    packed = "raw" in vectors.columns
    vectors = vectors.select(id_col, "term_ids", *(["raw", "square"] if packed else ["weights"]))
    model = model_of(centroids, k, id_col, count_terms(vectors), max_bytes)

    def refer() -> tuple:
        scored = model.score(_weighted(vectors)).drop("cost", *(["weights"] if packed else []))
        table = written(scored.sortWithinPartitions("margin"))
        model.release()
        reclaim(vectors.sparkSession)
        return table, model, *model.sums(_weighted(table), relabel=False)

    reference, at, sums, sizes, rows = refer()
    fresh = True
    for _ in range(max_iter):
        change = None
        if fresh:
            total, members, read = sums, sizes, rows
        else:
            change, moved, read = model.sums(_weighted(_failing(reference, model.apart(at))), relabel=True)
            total, members = sums.plus(change), sizes + moved
        if looked is not None:
            looked.append(read)
        after = total.means(np.round(members))
        step = float(after.apart(model).max())
        if change is not None:
            change.drop()
        if model is not at:
            model.drop()
        model, fresh = after, False
        if step <= tol:
            break
        if read > FAILED_SHARE * rows and step < model.apart(at).max() / 2:
            sums.drop()
            at.drop()
            discard(reference)  # each row is in ``vectors``
            reference, at, sums, sizes, rows = refer()
            fresh = True
    if fresh:
        return reference.select(id_col, "cluster")
    near = model.score(_weighted(_failing(reference, model.apart(at))).select(id_col, "term_ids", "weights")).select(
        id_col, F.col("cluster").alias("_now"))
    # few rows are left to look at; the rest keeps its cluster
    return reference.select(id_col, "cluster").join(small_side(cut_lineage(near)), id_col, "left").select(
        id_col, F.coalesce("_now", "cluster").alias("cluster"))


def lloyd_kmeans(
    df: DataFrame,
    k: int = 3,
    seed: int = 42,
    max_iter: int = 300,
    tol: float = 1e-4,
    id_col: str = "response_id",
    text_col: str = "response",
    stop_words: Sequence[str] | None = None,
    start_ids: Sequence[int] | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, cluster)``: ``seed_documents`` and ``lloyd_vectors`` on the TF-IDF rows.

    ``start_ids`` fixes the documents the first centroids are.
    """
    rows, _, used = raw_vectors(df, id_col, text_col, stop_words)
    vectors = written(rows.select(id_col, "term_ids", "raw", "square"))
    for delete in used:
        delete()
    reclaim(df.sparkSession)
    starts = list(start_ids) if start_ids is not None else seed_documents(_weighted(vectors), k, seed, id_col, max_bytes)
    if not starts:  # no answer has a term
        return vectors.select(id_col, F.lit(0).alias("cluster"))
    centroids = centroids_from_documents(_weighted(vectors), starts, id_col)
    return lloyd_vectors(vectors, centroids, len(starts), max_iter, tol, id_col, max_bytes)


def renumber_clusters(labels: DataFrame, id_col: str = "response_id") -> DataFrame:
    """Number clusters by their smallest member id, so that ids do not depend on the fit."""
    first = labels.groupBy("cluster").agg(F.min(id_col).alias("_first"))
    ordered = [row["cluster"] for row in first.orderBy("_first").collect()]  # one row per cluster
    renamed: Column = F.array_position(F.array(*[F.lit(cluster) for cluster in ordered]), F.col("cluster")) - 1
    return labels.withColumn("cluster", renamed.cast("int"))


def kmeans_cluster(
    df: DataFrame,
    k: int = 3,
    seed: int = 42,
    id_col: str = "response_id",
    text_col: str = "response",
    stop_words: Sequence[str] | None = None,
    max_iter: int = 300,
    tol: float = 1e-4,
    start_ids: Sequence[int] | None = None,
) -> DataFrame:
    """The answers with a ``cluster`` column, every answer kept.

    ``lloyd_kmeans`` at every size, clusters numbered by their smallest member id. Labels do not
    depend on the partitions. A null answer has no terms, like an empty one.
    """
    stop_words = resolve_stop_words(df.sparkSession, stop_words)
    # the fit is read again below, once to number it and once to join it
    labels = cut_lineage(lloyd_kmeans(df, k, seed, max_iter, tol, id_col, text_col, stop_words, start_ids))
    return df.join(renumber_clusters(labels, id_col), id_col)
