"""Mixing of sources to target weights by temperature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textinsight.llm.common import materialize
from textinsight.session import small_side

TARGET_ENTROPY = 0.95  # share of the entropy of equal weights
MAX_REPEATS = 4.0
MAX_EXPONENT = 16.0
BUDGET_RATIO = 1.0  # tokens of the mixture against tokens there are
SEED = 7
_LEVELS = 5  # of the bisection, in one job
_ROUNDS = 6
_BUCKET_BITS = 12


def _draw(seed: int, block: Column, id_col: Column, text_hash: Column) -> Column:
    """Place of a document in the permutation of a block: 60 even bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), block.cast("bigint"), id_col, text_hash), 4)


def _bisect(shares: DataFrame, holds, start: float, end: float) -> float:
    """Smallest exponent from ``start`` to ``end`` for which ``holds(entropy, most)``, which must hold from there on.

    ``end`` where it never holds. A job evaluates all exponents that the next halvings can ask for, over
    the table of sources.
    """
    scale = 1 << _LEVELS * _ROUNDS
    low, high = 0, scale  # in steps of 2**-30 of the way

    def exponent(at: int) -> float:
        return start + (end - start) * (at / scale)

    for _ in range(_ROUNDS + 1):
        width = high - low
        if width <= 1:
            break
        asked = sorted({low} | {low + width * i // (1 << _LEVELS) for i in range(1, 1 << _LEVELS)})
        table = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(exponent(a)).alias("x")) for a in asked])
        power = F.exp(F.col("t.x") * F.ln("share"))
        found = shares.select("share", F.explode(table).alias("t")).groupBy("t.a").agg(
            F.sum(power).alias("z"), F.sum(power * F.col("t.x") * F.ln("share")).alias("s"),
            F.max(power / F.col("share")).alias("m"),
        ).collect()  # as many rows as exponents asked for
        good = {r["a"]: holds(math.log(r["z"]) - r["s"] / r["z"], r["m"] / r["z"]) for r in found}
        if good[low]:
            return exponent(low)
        for _ in range(_LEVELS):
            middle = low + (high - low) // 2
            if high - low <= 1 or middle not in good:
                break
            low, high = (low, middle) if good[middle] else (middle, high)
    return exponent(high)


def plan_mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget_ratio: float = BUDGET_RATIO,
    seed: int = SEED, max_exponent: float = MAX_EXPONENT,
) -> DataFrame:
    """One row per source: ``source, tokens, exponent, weight, quota, blocks, cutoff``.

    A source with share p of all tokens gets the weight p**exponent, normalised. The exponent is that
    at which the entropy of the weights is ``target_entropy`` of that of equal weights: below 1 where
    the sources are less even than that, above 1, up to ``max_exponent``, where they are more even.
    It is moved towards 1 where needed until no source is repeated more than ``max_repeats`` times.
    With all weights at their own share and still too many repeats the budget is cut to what the
    limit allows. ``blocks`` whole permutations of the source fit into its quota of tokens; of the
    next one the documents drawn up to ``cutoff`` do.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = materialize(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n"),
    ))
    tokens = materialize(sizes.groupBy("source").agg(F.sum("n").alias("tokens")))
    total, count = tokens.filter("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    total = total or 0
    budget = int(total * min(budget_ratio, max_repeats))
    shares = tokens.filter("tokens > 0").select("source", "tokens", (F.col("tokens") / max(total, 1)).alias("share"))
    exponent = 1.0
    if count > 1:
        goal = target_entropy * math.log(count)
        # Entropy falls as the exponent grows, so the halving looks for the first exponent below the goal.
        exponent = _bisect(shares, lambda entropy, most: entropy < goal, 0.0, max_exponent)
        ratio = min(budget_ratio, max_repeats)
        if exponent < 1:
            exponent = max(exponent, _bisect(shares, lambda entropy, most: most * ratio <= max_repeats, 0.0, 1.0))
        elif exponent > 1:  # the largest sources are repeated most
            exponent = min(exponent, _bisect(shares, lambda entropy, most: most * ratio > max_repeats, 1.0, max_exponent))
    weights = shares.withColumn("power", F.exp(F.lit(exponent) * F.ln("share")))
    z = weights.agg(F.sum("power")).first()[0] or 1.0
    quotas = weights.withColumn("weight", F.col("power") / z).withColumn(
        "quota", F.floor(F.round(F.col("weight") * budget, 6)).cast("bigint")).withColumn(
        "blocks", F.floor(F.col("quota") / F.col("tokens")).cast("int")).withColumn(
        "rest", F.col("quota") - F.col("blocks") * F.col("tokens")).drop("power", "share")
    quotas = materialize(quotas)
    at = _draw(seed, F.col("blocks"), F.col("id"), F.col("hash"))
    open_ = quotas.filter("rest > 0").select(F.col("source").alias("of"), "blocks", "rest")
    drawn = sizes.join(small_side(open_), F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "rest", "n", at.alias("at")).withColumn("bucket", F.shiftright("at", 60 - _BUCKET_BITS))
    # Sums of at most 2**12 buckets a source, then the documents of the one bucket that the quota ends in.
    along = Window.partitionBy("source").orderBy("bucket")
    sums = drawn.groupBy("source", "bucket").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    run = sums.withColumn("before", F.sum("n").over(along) - F.col("n"))
    edge = materialize(run.filter("before <= rest and before + n > rest").select(
        F.col("source").alias("of"), F.col("bucket").alias("edge"), "before"))
    inside = drawn.join(small_side(edge), F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("edge")))
    ordered = inside.withColumn("sum", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("at")))
    last = ordered.filter("sum <= rest").groupBy("source").agg(F.max("at").alias("cutoff"))
    cut = edge.join(last, F.col("of").eqNullSafe(F.col("source")), "left").select(
        "of", F.coalesce("cutoff", F.shiftleft(F.col("edge"), 60 - _BUCKET_BITS) - 1).alias("cutoff"))
    return tokens.select("source", "tokens").alias("t").join(
        quotas.drop("tokens").alias("q"), F.col("t.source").eqNullSafe(F.col("q.source")), "left",
    ).join(cut, F.col("t.source").eqNullSafe(F.col("of")), "left").select(
        F.col("t.source").alias("source"), "t.tokens", F.lit(exponent).alias("exponent"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("quota", F.lit(0)).alias("quota"),
        F.when(F.col("t.tokens") == 0, 1).otherwise(F.coalesce("blocks", F.lit(0))).alias("blocks"),
        F.coalesce("cutoff", F.lit(-1)).alias("cutoff"),
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget_ratio: float = BUDGET_RATIO,
    seed: int = SEED, max_exponent: float = MAX_EXPONENT,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, with ``mix_block`` and ``mix_place``.

    ``mix_block`` numbers the permutations of the source from 0. Sorted by ``mix_place`` (0 to 1)
    the mixture has all sources at their weights throughout. See ``plan_mixture`` for the weights;
    no source takes more tokens than its quota. Texts stay where they are: a document finds out by
    itself whether it is drawn, from its source's row.

    A null source is a source. Null and blank texts have no tokens; a source of only such texts is
    taken once. Rows that agree in id and text are drawn together.
    """
    plan = materialize(plan_mixture(docs, id_col, text_col, source_col, target_entropy, max_repeats, budget_ratio, seed, max_exponent))
    plan = small_side(plan.select(
        F.col("source").alias("_of"), F.col("blocks").alias("_blocks"), F.col("cutoff").alias("_cutoff"),
        F.greatest(F.col("quota") / F.greatest("tokens", F.lit(1)), F.lit(1e-9)).alias("_rounds")))
    docs = docs.drop("mix_block", "mix_place")
    hashed = F.xxhash64(text_col)
    extra = (_draw(seed, F.col("_blocks"), F.col(id_col), hashed) <= F.col("_cutoff")).cast("int")
    picked = docs.join(plan, docs[source_col].eqNullSafe(F.col("_of"))).withColumn("_times", F.col("_blocks") + extra)
    taken = picked.filter("_times > 0").withColumn("mix_block", F.explode_outer(F.sequence(F.lit(0), F.col("_times") - 1)))
    place = (F.col("mix_block") + _draw(seed, F.col("mix_block"), F.col(id_col), hashed) / float(1 << 60)) / F.greatest("_rounds", F.lit(1e-9))
    return taken.withColumn("mix_place", F.least(place, F.lit(1.0))).select(*docs.columns, "mix_block", "mix_place")
