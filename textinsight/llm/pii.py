"""Keyed surrogates for personal data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textinsight.llm.common import materialize

# Given names by gender and script, each list ordered; a surrogate comes from the same list.
GIVEN_NAMES = (
    ("James", "John", "Robert", "Michael", "David", "William", "Thomas", "Peter", "Paul", "Hans", "Karl", "Jean", "Pierre", "Luis", "Carlos", "Juan"),
    ("Mary", "Anna", "Linda", "Susan", "Sarah", "Emma", "Laura", "Julia", "Claire", "Marie", "Sophie", "Greta", "Ingrid", "Carmen", "Lucia", "Elena"),
    ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай"),
    ("Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина"),
    ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"),
    ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία"),
)
# Titles that announce a family name.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Don", "Doña")
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ",
    "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώ",
)
HEX = ("0123456789", "abcdef")
# Patterns of the types; where several match at a place the first listed wins.
EMAIL = r"(?<![\w.%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}+(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ADDRESS = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w])(?!\.[0-9])"
SOCIAL = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})|\([0-9]{3}\)|[0-9]{3}(?=[.-][0-9]{3}[.-][0-9]{4}))(?:[ .-]?[0-9]{2,4}){2,4}+(?![\w])"
CODE = r"^\+[0-9]{1,3}(?=[ .-])"
CARD = r"(?<![\w])[0-9](?:[ -]?[0-9]){12,18}+(?![\w])"
_SURNAME = r"\p{Lu}[\p{L}\p{M}'’-]++"
NAME = (
    rf"(?=\p{{Lu}})(?:(?<![\p{{L}}\p{{N}}])(?:{'|'.join(n for names in GIVEN_NAMES for n in names)}) {_SURNAME}"
    rf"|(?<=(?<![\p{{L}}])(?:{'|'.join(TITLES)})\.? ){_SURNAME})"
)
PATTERN = f"{EMAIL}|{SECRET}|{ADDRESS}|{SOCIAL}|{PHONE}|{CARD}|{NAME}"
ROUNDS = 8  # tweaks tried to keep surrogates off the values that occur


def _kind(found: Column) -> Column:
    return (
        F.when(found.contains("@"), "email").when(found.rlike(f"^(?:{SECRET})$"), "secret")
        .when(found.rlike(f"^(?:{ADDRESS})$"), "address").when(found.rlike(f"^(?:{SOCIAL})$"), "social")
        .when(found.rlike(r"^[+(]|^[0-9]{3}[.-][0-9]{3}[.-]"), "phone").when(found.rlike("^[0-9]"), "card").otherwise("name")
    )


def _canonical(kind: Column, found: Column) -> Column:
    """What all ways to write an entity have in common."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    code = F.regexp_extract(found, CODE, 0)  # a country code counts as one where it stands apart
    return F.when(kind == "phone", F.concat_ws("|", code, digits)).when(kind.isin("card", "social"), digits).when(kind == "name", found).otherwise(F.lower(found))


def _shift(key: Column, state: Column, size: int) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, state), 256), 1, 12), 16, 10).cast("bigint") % size


def _pass(symbols: Column, key: Column, alphabets: Sequence[str]) -> Column:
    """Each symbol moves within its alphabet by a distance that the key and all results before it give.

    Undone symbol by symbol, so different inputs of one form give different results. Symbols of no
    alphabet stay and do not count.
    """

    def step(acc: Column, symbol: Column) -> Column:
        moved = None
        for alphabet in alphabets:
            at = F.call_function("instr", F.lit(alphabet), symbol)
            to = (at - 1 + _shift(acc.key, acc.state, len(alphabet))) % len(alphabet) + 1
            new = F.substring(F.lit(alphabet), to.cast("int"), F.lit(1))
            moved = F.when(at > 0, new) if moved is None else moved.when(at > 0, new)
        return F.struct(
            acc.key.alias("key"), F.concat(acc.state, F.coalesce(moved, F.lit(""))).alias("state"),
            F.array_append(acc.out, F.coalesce(moved, symbol)).alias("out"))

    return F.aggregate(symbols, _start(key), step, lambda acc: acc.out)


def _start(key: Column) -> Column:
    """The key is part of what a step gets, so that it is worked out once."""
    return F.struct(key.alias("key"), F.lit("").alias("state"), F.array().cast("array<string>").alias("out"))


def _moved(text: Column, key: Column, alphabets: Sequence[str]) -> Column:
    """Forward and backward, so that every symbol depends on all."""
    symbols = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    back = _pass(F.reverse(_pass(symbols, F.concat(key, F.lit("|1")), alphabets)), F.concat(key, F.lit("|2")), alphabets)
    return F.reverse(back)


def _cased(new: Column, old: Column) -> Column:
    """Capitals where the old text has them."""
    letters = F.filter(F.split(old, ""), lambda c: c != "")
    pairs = F.zip_with(new, letters, lambda n, o: F.when((o != F.lower(o)) & (F.length(F.upper(n)) == 1), F.upper(n)).otherwise(n))
    return F.array_join(pairs, "")


def surrogate(kind: Column, found: Column, secret: Column) -> Column:
    """Replacement of one occurrence: same type, format, script, case and, of a name, gender.

    A keyed one-to-one map of all values of a form onto themselves, so different entities stay
    different and every way to write one entity gets the same replacement.
    """
    form = F.length(F.regexp_replace(found, r"[^\p{L}\p{N}]", ""))
    key = F.concat_ws("|", secret, kind, form.cast("string"))
    plain = _cased(_moved(found, key, ALPHABETS), found)
    octets = F.split(found, r"\.")

    def octet(acc: Column, value: Column) -> Column:
        new = ((value.cast("int") + _shift(acc.key, acc.state, 256)) % 256).cast("string")
        return F.struct(acc.key.alias("key"), F.concat_ws(".", acc.state, new).alias("state"),
                        F.array_append(acc.out, new).alias("out"))

    address = F.array_join(F.reverse(F.aggregate(
        F.reverse(F.aggregate(octets, _start(key), octet, lambda acc: acc.out)), _start(key), octet, lambda acc: acc.out)), ".")
    top = F.regexp_extract(found, r"\.[A-Za-z]+$", 0)
    mail = F.substring(found, F.lit(1), F.length(found) - F.length(top))
    mail_key = F.concat_ws("|", key, F.lower(top))
    code = F.regexp_extract(found, CODE, 0)
    number = F.substring(found, F.length(code) + 1, F.length(found))
    number_key = F.concat_ws("|", secret, kind, F.length(F.regexp_replace(number, "[^0-9]", "")).cast("string"), code)
    first = F.regexp_extract(found, "^([^ ]+) ", 1)
    family = F.substring(found, F.length(first) + F.when(first == "", 1).otherwise(2), F.length(found))
    family_key = F.concat_ws("|", secret, kind, F.length(family).cast("string"))
    new_family = _cased(_moved(family, family_key, ALPHABETS), family)
    # One shift for all given names of a list before one family name, whatever their lengths.
    given_key = F.concat_ws("|", secret, kind, F.lower(new_family))
    given = None
    for i, names in enumerate(GIVEN_NAMES):
        listed = F.array(*[F.lit(n) for n in names])
        at = F.array_position(listed, first)
        new = F.get(listed, ((at - 1 + _shift(given_key, F.lit(str(i)), len(names))) % len(names)).cast("int"))
        given = F.when(at > 0, new) if given is None else given.when(at > 0, new)
    name = F.concat_ws(" ", given, new_family)
    return (
        F.when(kind == "email", F.concat(_cased(_moved(mail, mail_key, ALPHABETS), mail), top))
        .when(kind == "secret", _cased(_moved(found, key, HEX), found))
        .when(kind == "address", address)
        .when(kind == "phone", F.concat(code, _cased(_moved(number, number_key, ALPHABETS), number)))
        .when(kind == "name", name).otherwise(plain)
    )


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, found``: every distinct string of personal data in any text."""
    rows = docs.select(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(PATTERN), F.lit(0)).alias("all"))
    return rows.select(F.explode_outer("all").alias("found")).filter("found is not null").distinct().select(
        _kind(F.col("found")).alias("kind"), "found")


def replace_personal_data(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text",
                          keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with the text replaced, and ``n_replaced``.

    E-mail, IP, phone, card and social security numbers, keys in hexadecimal, and names after a
    title or a known given name get surrogates that only ``key`` determines. The collision check
    runs over the distinct entities of the whole corpus: two that differ must have different
    surrogates, else it raises; and no surrogate should be a value that occurs, so the key is
    tweaked for a type until none does (``ROUNDS`` times at most; a value that occurs is itself
    replaced everywhere, so even then no two entities are confused).

    Null texts stay null, texts without personal data as they are. Repeated rows come out repeated.
    """
    spark = docs.sparkSession
    keep = list(docs.columns if keep is None else keep)
    known = materialize(entities(docs, text_col).withColumn("canonical", _canonical(F.col("kind"), F.col("found"))))
    distinct = materialize(known.groupBy("kind", "canonical").agg(F.min("found").alias("found")))
    kinds = ["email", "secret", "address", "social", "phone", "card", "name"]
    tweaks, open_ = dict.fromkeys(kinds, 0), set(kinds)
    for round_ in range(ROUNDS):
        given = distinct.filter(F.col("kind").isin(sorted(open_))).withColumn(
            "new", _canonical(F.col("kind"), surrogate(F.col("kind"), F.col("found"), _tweaked(key, F.col("kind"), tweaks))))
        given = materialize(given)
        twice = given.groupBy("kind", "new").count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"two entities of type {twice[0]['kind']} share a surrogate")
        met = given.join(distinct.select("kind", F.col("canonical").alias("new")), ["kind", "new"], "left_semi")
        open_ = {r["kind"] for r in met.select("kind").distinct().collect()}  # seven types at most
        if not open_ or round_ == ROUNDS - 1:
            break
        for kind in open_:
            tweaks[kind] += 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("_text"),
                       F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("_found"))
    typed = F.transform("_found", lambda x: F.struct(_kind(x).alias("kind"), x.alias("found")))
    new = F.transform(typed, lambda x: surrogate(x.kind, x.found, _tweaked(key, x.kind, tweaks)))
    rows = rows.withColumn("_new", F.when(F.size("_found") > 0, new).otherwise(F.array().cast("array<string>")))
    between = F.split("_text", PATTERN)
    joined = F.array_join(F.zip_with(between, F.col("_new"), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    out = F.when(F.size("_found") == 0, F.col("_text")).otherwise(joined)
    others = [c for c in keep if c != text_col]
    return rows.select(*[F.col(f"`{c}`") for c in others], out.alias(text_col), F.size("_found").alias("n_replaced"))


def _tweaked(key: str, kind: Column, tweaks: dict[str, int]) -> Column:
    tweak = F.lit(0)
    for name, value in tweaks.items():
        tweak = F.when(kind == name, value).otherwise(tweak) if value else tweak
    return F.concat_ws("|", F.lit(key), tweak.cast("string"))
