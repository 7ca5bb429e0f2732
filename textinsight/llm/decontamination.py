"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textinsight.llm.common import materialize
from textinsight.session import lookup_join, small_side

WINDOW = 5
COVERAGE = 0.5
SLACK = 3
BROADCAST_WINDOWS = 500_000
LEAST_TOKENS = 2  # an item of a single word is found everywhere
# Marks that begin a typed placeholder, and the one that joins the parts of a number.
NUMBER, UNIT, NAME, JOINT = "\u0001", "\u0002", "\u0003", "\u0004"
# Words that are a unit after a number.
UNITS = (
    "mm|cm|dm|m|km|inch|inches|feet|ft|yards?|miles?|mg|g|kg|tons?|pounds?|lbs?|ml|l|liters?|litres?|gallons?|"
    "s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|percent|dollars?|euros?|cents?|pence|"
    "usd|eur|gbp|mph|kmh|hz|khz|mhz|w|kw|v|mv|j|kj|n|pa|kpa|k|degrees?"
)


def canonical_tokens(text: Column) -> Column:
    """Lower-case words of a text, numbers, units and names each with the mark of its type in front.

    White space is collapsed first. A number is a run of digits with single separators inside. A unit
    is one of a fixed list of words right after a number. A name is a word with a capital letter after
    a lower-case word or a comma, that is, not at the start of a sentence. Null gives no tokens.
    """
    out = F.translate(F.coalesce(text, F.lit("")), NUMBER + UNIT + NAME + JOINT, "    ")
    out = F.regexp_replace(out, r"[\s\p{Z}]++", " ")
    out = F.regexp_replace(out, r"(?<=\d)[.,:](?=\d)", JOINT)
    out = F.regexp_replace(out, rf"\d[\d{JOINT}]*+", f" {NUMBER}$0 ")
    out = F.regexp_replace(out, rf"(?i)({NUMBER}[\d{JOINT}]+ ++)({UNITS})\b", f"$1{UNIT}$2")
    out = F.regexp_replace(out, r"(?<=[\p{Ll},] )\p{Lu}[\p{L}\p{M}]+", f"{NAME}$0")
    return F.array_remove(F.split(F.lower(out), rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}-{JOINT}]+"), "")


def _typed(token: Column) -> Column:
    return F.ascii(token) <= ord(NAME)


def _plain_hash(token: Column) -> Column:
    return F.xxhash64(F.when(_typed(token), F.substring(token, 2, 1 << 30)).otherwise(token))


def _template_hash(token: Column) -> Column:
    return F.xxhash64(F.lit("template"), F.when(_typed(token), F.substring(token, 1, 1)).otherwise(token))


def _rolled(hashes: str, size: int) -> Column:
    """Hashes of all runs of ``size`` values."""
    return F.when(F.size(hashes) >= size, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + j) for j in range(size)]),
    )).otherwise(F.array().cast("array<bigint>"))


def _placed(rows: DataFrame, keep: list[str], window: int, sizes: list[int]) -> DataFrame:
    """``keep, template, size, at, window``: every plain window of each of ``sizes``, every template window of ``window``.

    A row is a few numbers: no text, no tokens.
    """
    tokens = rows.select(*keep, canonical_tokens(F.col("text")).alias("tokens"))
    hashed = tokens.select(*keep, F.transform("tokens", _plain_hash).alias("p"), F.transform("tokens", _template_hash).alias("t"))
    kinds = [F.struct(F.lit(True).alias("template"), F.lit(window).alias("size"), _rolled("t", window).alias("w"))]
    kinds += [F.struct(F.lit(False).alias("template"), F.lit(s).alias("size"), _rolled("p", s).alias("w")) for s in sizes]
    kind = hashed.select(*keep, F.explode(F.array(*kinds)).alias("k")).select(*keep, "k.template", "k.size", "k.w")
    return kind.select(*keep, "template", "size", F.posexplode("w").alias("at", "window"))


def _runs(hits: DataFrame, whole: list[str], slack: int) -> DataFrame:
    """Hits with the number of the run of diagonals they belong to."""
    along = Window.partitionBy(*whole).orderBy("ahead", "item_at")
    new = F.coalesce(F.col("ahead") - F.lag("ahead").over(along) > slack, F.lit(True)).cast("int")
    return hits.withColumn("new", new).withColumn(
        "run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, slack: int = SLACK,
    max_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """``id, text_hash, item_id, coverage, exact, place``: documents that hold a benchmark item, and no others.

    Texts and items become templates: numbers, units and names turn into placeholders of their type.
    All windows of ``window`` template tokens of all documents are hash-joined to those of the items, and
    so are the windows of the plain lower-case tokens, so that other capitals or line breaks hide
    nothing. An item of fewer tokens, down to ``LEAST_TOKENS``, is one plain window of its own size.
    Matches of a document and an item are told apart by how far the text is ahead of the item; runs of
    such diagonals not more than ``slack`` apart belong together, as words put in or dropped shift the rest.

    An item is found where a run holds ``coverage`` of its plain windows. It is also found where ``coverage`` of its template windows are there, one at least with a plain word, and the
    slots hold together: most have equal values, or one value of the item stands for one value of the
    text but for a quarter of edited slots. Each diagonal is judged by itself and each run as a whole;
    in a run every window of the item takes one match only, one with equal values or else that of the
    longest unbroken stretch. So a question with other numbers or names is caught, a chance likeness
    of templates is not. ``coverage`` is the largest share of windows found, ``exact`` says that their
    values all agree, and ``place`` is the first matching token.

    Windows without a plain word are looked up by their values; by their types they count only along
    the diagonals that windows with a word have shown, so number tables do not meet in all pairs.
    What is joined is numbers; slot values are fetched for the matches that are left, by one more look
    at their documents. The windows of the items are broadcast up to a checked number and size of them
    and joined by shuffle beyond it, spread by document.

    Null texts and items hold nothing. Rows that agree in id and text count once.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    tokens = items.select("item_id", F.xxhash64("text").alias("item_hash"), "text", canonical_tokens(F.col("text")).alias("item_tokens"))
    tokens = materialize(tokens.filter(F.size("item_tokens") >= LEAST_TOKENS).withColumn(
        "size", F.least(F.lit(window), F.size("item_tokens"))))
    sizes = sorted(row["size"] for row in tokens.select("size").distinct().collect())  # at most ``window`` numbers
    item = ["item_id", "item_hash"]
    own = _placed(tokens.withColumnRenamed("size", "own_size"), [*item, "own_size"], window, sizes)
    own = own.filter("size = own_size").withColumnRenamed("at", "item_at")
    starts = F.sequence(F.lit(0), F.size("item_tokens") - F.col("size"))
    worded = F.transform(starts, lambda i: F.exists(F.slice("item_tokens", i + 1, F.col("size")), lambda t: ~_typed(t)))
    worded = tokens.select(*item, (F.size("item_tokens") - F.col("size") + 1).alias("windows"), F.posexplode(worded).alias("item_at", "worded"))
    # Spark sizes exploded rows like those before: it would broadcast them at any number
    own = materialize(own.join(worded.hint("merge"), [*item, "item_at"]))
    unworded = own.filter("template and not worded").groupBy(*item).agg(F.collect_list("item_at").alias("unworded"))
    keys = own.filter("worded or not template").select("window", "template", *item, "item_at", "windows")

    who = F.coalesce(F.concat(F.lit("+"), F.col(id_col).cast("string")), F.lit("-"))
    rows = docs.select(F.col(id_col).alias("id"), who.alias("who"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    placed = _placed(rows, ["who", "text_hash"], window, sizes).select("who", "text_hash", "at", "window")
    whole = ["who", "text_hash", *item]
    found = lookup_join(placed, keys, ["window"], "who", max_rows=max_windows)
    hits = found.select(*whole, "template", "windows", (F.col("at") - F.col("item_at")).alias("ahead"), "item_at")
    hits = materialize(hits.dropDuplicates([*whole, "template", "ahead", "item_at"]))

    equal = hits.filter("not template")
    enough = equal.groupBy(*whole, "windows").agg(F.count_distinct("item_at").alias("n")).filter(F.col("n") >= coverage * F.col("windows"))
    equal = _runs(equal.join(enough.select(*whole), whole, "left_semi"), whole, slack)
    verbatim = equal.groupBy(*whole, "run", "windows").agg(
        F.count_distinct("item_at").alias("n"), F.min(F.col("ahead") + F.col("item_at")).alias("place"),
    ).filter(F.col("n") >= coverage * F.col("windows")).select(
        *whole, (F.col("n") / F.col("windows")).alias("share"), F.lit(True).alias("exact"), "place")

    good = materialize(verbatim.union(_by_template(rows, hits, tokens, unworded, whole, window, coverage, slack)))
    best = F.max(F.struct("share", "exact", (-F.col("place")).alias("first")))
    number = F.when(F.col("who") != "-", F.substring("who", 2, 1 << 30)).cast(docs.schema[id_col].dataType)
    return good.groupBy("who", "text_hash", "item_id").agg(best.alias("best")).select(
        number.alias(id_col), "text_hash", "item_id", F.col("best.share").alias("coverage"), "best.exact", (-F.col("best.first")).alias("place"))


def _by_template(rows, hits, tokens, unworded, whole, window, coverage, slack) -> DataFrame:
    """``whole, share, exact, place`` of the items whose templates a document holds."""
    item = ["item_id", "item_hash"]
    typed = hits.filter("template").join(small_side(materialize(unworded)), item, "left")
    more = F.coalesce(F.size("unworded"), F.lit(0))
    enough = typed.groupBy(*whole).agg(
        F.count_distinct("item_at").alias("n"), F.max(more).alias("more"), F.max("windows").alias("windows"))
    enough = enough.filter(F.col("n") + F.col("more") >= coverage * F.col("windows"))
    typed = materialize(typed.join(enough.select(*whole), whole, "left_semi"))
    # windows without a word are tried on the diagonals of those with one
    tried = typed.filter("unworded is not null").select(*whole, "windows", "ahead", "unworded").dropDuplicates([*whole, "ahead"])
    tried = tried.select(*whole, "windows", "ahead", F.explode("unworded").alias("item_at")).filter(F.col("ahead") + F.col("item_at") >= 0)
    places = typed.select(*whole, "windows", "ahead", "item_at").unionByName(tried.select(*whole, "windows", "ahead", "item_at"))
    places = places.withColumn("at", F.col("ahead") + F.col("item_at"))
    needed = materialize(places.select("who", "text_hash", "at").distinct())
    some = small_side(materialize(needed.select("who", "text_hash").distinct()))
    texts = rows.join(some, ["who", "text_hash"], "left_semi").select("who", "text_hash", canonical_tokens(F.col("text")).alias("tokens"))
    lists = needed.groupBy("who", "text_hash").agg(F.collect_list("at").alias("places"))
    pieces = F.transform("places", lambda at: F.struct(at.alias("at"), F.slice("tokens", at + 1, window).alias("to")))
    slices = texts.join(lists, ["who", "text_hash"]).select("who", "text_hash", F.explode(pieces).alias("s")).select(
        "who", "text_hash", "s.at", "s.to").dropDuplicates(["who", "text_hash", "at"])
    named = tokens.select(*item, F.posexplode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("item_tokens") - window)), lambda i: F.slice("item_tokens", i + 1, window)))
        .alias("item_at", "of"))
    # by shuffle, as places are sized like the hits before the explode
    met = places.hint("merge").join(slices, ["who", "text_hash", "at"]).join(small_side(materialize(named)), [*item, "item_at"])
    same_types = F.forall(F.zip_with("of", "to", lambda a, b: _template_hash(a) == _template_hash(b)), lambda ok: F.coalesce(ok, F.lit(False)))
    pairs = F.filter(
        F.arrays_zip(F.sequence("item_at", F.col("item_at") + window - 1).alias("pos"), F.col("of"), F.col("to")),
        lambda p: _typed(p.of))
    slotted = met.filter((F.size("to") == window) & same_types).select(*whole, "windows", "ahead", "item_at", pairs.alias("slots"))
    slotted = _runs(slotted.select(
        "*", (F.size("slots") < window).alias("plain"), F.forall("slots", lambda p: p.of == p.to).alias("same")), whole, slack)
    diagonal = Window.partitionBy(*whole, "ahead").orderBy("item_at")
    slotted = slotted.withColumn("stretch", F.col("item_at") - F.row_number().over(diagonal))
    slotted = slotted.withColumn("length", F.count("*").over(Window.partitionBy(*whole, "ahead", "stretch")))
    slotted = materialize(slotted)
    best = Window.partitionBy(*whole, "run", "item_at").orderBy(F.desc("same"), F.desc("length"), "ahead")
    merged = slotted.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")
    return _judged(slotted, [*whole, "ahead"], coverage).union(_judged(merged, [*whole, "run"], coverage))


def _judged(hits: DataFrame, by: list[str], coverage: float) -> DataFrame:
    """The alignments, one for each value of ``by``, that show the item."""
    seen = hits.groupBy(*by, "windows").agg(
        F.count("*").alias("n"), F.max("plain").alias("plain"),
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"), F.min(F.col("ahead") + F.col("item_at")).alias("place"),
    ).filter((F.col("n") >= coverage * F.col("windows")) & F.col("plain"))
    # how often each value of the item, and each pair of values, is there: sorted, so that counting is one pass
    edited = F.size(F.filter("slots", lambda p: p.of != p.to))
    spread = seen.withColumn("edited", edited).withColumn("slot", F.explode_outer("slots"))
    counted = spread.groupBy(*by, "windows", "n", "place", "edited", F.size("slots").alias("many"), F.col("slot.of").alias("of"), F.col("slot.to").alias("to")).agg(
        F.count("slot").alias("held"))
    value = Window.partitionBy(*by, "of")
    astray = F.sum(F.when(2 * F.col("held") <= F.col("among"), F.col("held")).otherwise(0))
    judged = counted.withColumn("among", F.sum("held").over(value)).groupBy(*by, "windows", "n", "place", "edited", "many").agg(
        astray.alias("astray"))
    together = (2 * F.col("edited") < F.col("many")) | (4 * F.col("astray") <= F.col("many"))
    return judged.filter(together).select(
        *by[:4], (F.col("n") / F.col("windows")).alias("share"), (F.col("edited") == 0).alias("exact"), "place")
