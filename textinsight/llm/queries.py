"""Registered queries of this package, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textinsight.llm import language_id, lm_scoring
from textinsight.llm.common import id_remainder
from textinsight.llm.decontamination import contaminated
from textinsight.llm.exact_dedup import exact_duplicates
from textinsight.llm.html_text import extract_pages
from textinsight.llm import license_scan as licenses
from textinsight.llm.license_scan import license_scan
from textinsight.llm import merkle
from textinsight.llm.mixing import mix_sources
from textinsight.llm.packing import pack_documents
from textinsight.llm.pii import replace_personal_data
from textinsight.llm.sharding import hilbert_shards
from textinsight.llm.simhash import near_duplicates
from textinsight.llm.spelling import letter_runs, spelling_variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 3) == 1
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.predict_language(rows, model, keep=["doc_id", "held_out"])


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(_table(spark, sf_dir, "documents"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_block", "mix_place")


def op6_surrogate_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(_table(spark, sf_dir, "documents"), "surrogates", keep=["doc_id", "text"])


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) != 2)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "exact", "place")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claimed = F.when(tampered, merkle.leaf_digest(changed)).alias("claimed")
    found = merkle.merkle_manifest(docs, carry=[claimed])
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle.fold_proof(F.coalesce("claimed", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(letter_runs(_table(spark, sf_dir, "documents")))


def op13_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_html_extraction": op2_html_extraction,
    "op3_language_id": op3_language_id,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_temperature_mixing": op5_temperature_mixing,
    "op6_surrogate_generation": op6_surrogate_generation,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_context_tree_weighting": op8_context_tree_weighting,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_template_decontamination": op10_template_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_sum_of_squares_packing": op13_sum_of_squares_packing,
}

_TEMPLATES = ",\n".join(
    f"('{text}', '{label}', {exact}, {grams}, {at}, '{a}', '{b}', '{c}')"
    for text, label, exact, grams, at, (a, b, c) in licenses._template_rows(licenses.BASE_PHRASES, licenses.TEMPLATES, licenses.GRAM)
)

# CRC-32 in SQL: the table of the 256 bytes, and a fold over the bytes of a text.
_CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, beside the one row of ``crc``."""
    digit = "instr('0123456789ABCDEF', substr(hex(encode({0})), {1}, 1)) - 1"
    byte = f"({digit.format(text, '2 * k + 1')}) * 16 + {digit.format(text, '2 * k + 2')}"
    byte_list = f"list_transform(range(octet_length(encode({text}))), lambda k: CAST({byte} AS BIGINT))"
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte_list}),
      lambda a, b: xor(a // 256, crc.tab[xor(a, b) % 256 + 1])), 4294967295)"""


def _leaf(n_chars: str) -> str:
    fields = [f"CAST({n_chars if c == 'n_chars' else c} AS VARCHAR)" for c in merkle.FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


SQL = {
    "op1_license_scan": rf"""
WITH t(template, label, exact, grams, tpos, a, b, c) AS (VALUES {_TEMPLATES}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
v AS (SELECT doc_id, template, label, exact, grams, pos - tpos AS diagonal, bit_or(CAST(1 AS BIGINT) << tpos) AS bits, min(pos) AS s, max(pos) AS e
      FROM g JOIN t USING (a, b, c) GROUP BY ALL),
n AS (SELECT *, exact OR coalesce(diagonal - lag(diagonal) OVER w > {licenses.SLACK}, true) AS new FROM v
      WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
r AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM n),
u AS (SELECT doc_id, template, label, exact, grams, bit_or(bits) AS bits, min(s) AS s, max(e) AS e FROM r GROUP BY doc_id, template, label, exact, grams, run),
f AS (SELECT *, bit_count(bits) / grams AS share FROM u
      WHERE CASE WHEN exact THEN bit_count(bits) = grams
            ELSE bit_count(bits) >= {licenses.COVERAGE} * grams AND (bits >> (grams - 1)) & 1 = 1 AND e - s + 1 <= 2 * grams END)
SELECT d.doc_id, len(any_value(d.w)) AS n_words, count(s) FILTER (WHERE exact) AS n_base, min(s) FILTER (WHERE exact) AS first_word,
  max(s) FILTER (WHERE exact) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""",
    "op9_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS leaf,
        CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS claimed FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
up(g, level, pos, n, h) AS (SELECT g, 0, pos, n, leaf FROM p
      UNION ALL SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, level, pos // 2, n),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, pos, n, h) AS (SELECT 0, pos, n, h FROM s
      UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (SELECT p.g, p.pos, u.level, CASE WHEN b.h IS NULL THEN '-' WHEN b.pos < u.pos THEN 'L' || b.h ELSE 'R' || b.h END AS step
      FROM p JOIN up u ON u.g = p.g AND u.pos = p.pos >> u.level AND u.n > 1 LEFT JOIN up b ON b.g = u.g AND b.level = u.level AND b.pos = xor(u.pos, 1)
      UNION ALL SELECT p.g, p.pos, 1000 + u.level, CASE WHEN b.h IS NULL THEN '-' WHEN b.pos < u.pos THEN 'L' || b.h ELSE 'R' || b.h END
      FROM p JOIN s USING (g) JOIN top u ON u.pos = s.pos >> u.level AND u.n > 1 LEFT JOIN top b ON b.level = u.level AND b.pos = xor(u.pos, 1)),
proof AS (SELECT g, pos, list(step ORDER BY level) AS steps FROM steps GROUP BY g, pos),
f AS (SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(steps, []) AS steps, coalesce(claimed, leaf) AS said
      FROM p JOIN s USING (g) LEFT JOIN proof ON proof.g = p.g AND proof.pos = p.pos),
r AS (SELECT *, sha256(coalesce(list_aggregate(list_transform(steps, lambda x: x[2:]), 'string_agg', ''), '')) AS proof_sha256,
        list_reduce(list_prepend(said, steps), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM r""",
    "op12_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-zÀ-ÿ]+')) AS run FROM documents),
h AS (SELECT run, k, {_crc("(id || ':' || run)")} AS h FROM (SELECT id, run, count(*) AS k FROM r GROUP BY id, run), crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k) AS n FROM h GROUP BY 1),
v AS (SELECT word, CAST(n AS BIGINT) AS n FROM w WHERE length(word) >= 5 AND n >= 3),
c AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, v.word, v.n FROM c JOIN v ON v.word = c.cut UNION SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.cut),
best AS (SELECT word, count(*) AS n_near, min(ROW(-m, other)) AS b FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * v.n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * v.n THEN -b[1] END AS form_n
      FROM v LEFT JOIN best USING (word)),
walk(word, ends, form) AS (SELECT word, word, form FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.form)
SELECT f.word, f.form, walk.ends AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.form IS NULL""",
}
