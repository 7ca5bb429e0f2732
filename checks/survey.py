"""Queries of the survey workload."""

from __future__ import annotations

from pyspark.sql import functions as F

from textinsight.functions import text as T
from textinsight.functions.replies import parse_insight
from textinsight.operators import grouping, keywords, kmeans, prompts, report, sentiment, tfidf
from textinsight.operators.completion import complete
from textinsight.plans.survey import summarize_clusters
from textinsight.session import cut_lineage
from textinsight.sources import responses as R

from . import common as C

PART_CHARS = 50_000
KMEANS_SEED = 42
SEED_SQL = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS cluster FROM (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 3)"


def _joined(items):
    return F.array_join(items, " ")


def read_responses(spark, sf_dir):
    return R.read_responses(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


def drop_null_responses(spark, sf_dir):
    turns = C.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("text")).alias("response")
    )
    return R.drop_null_responses(turns)


def strip_nonblank(spark, sf_dir):
    padded = F.when(F.col("doc_id") % 5 == 0, "  \t").otherwise(
        F.concat(F.lit("  \t"), "text", F.lit("\n  "))
    )
    return R.strip_nonblank(C.documents(spark, sf_dir).select("doc_id", padded.alias("response")))


def split_responses(spark, sf_dir):
    return R.split_responses(C.documents(spark, sf_dir), ["doc_id"])


def lines_until_marker(spark, sf_dir):
    lines = C.documents(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split("text", T.LINE_BREAK)).alias("line_no", "line")
    )
    marked = lines.select(
        "doc_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        F.when((F.col("line_no") + F.col("doc_id")) % 7 == 5, "\t eNd ").otherwise(F.col("line")).alias("line"),
    )
    return R.lines_until_marker(marked, ["doc_id"])


def filter_cluster(spark, sf_dir):
    return grouping.filter_cluster(C.documents(spark, sf_dir), "de", "lang").select("doc_id", "text")


def tokenize_words(spark, sf_dir):
    return C.documents(spark, sf_dir).select("doc_id", _joined(T.words(F.col("text"))).alias("words"))


def tokenize_terms(spark, sf_dir):
    return C.documents(spark, sf_dir).select("doc_id", _joined(T.terms(F.col("text"))).alias("terms"))


def remove_stop_words(spark, sf_dir):
    return C.documents(spark, sf_dir).select(
        "doc_id", _joined(T.terms(F.col("text"), C.STOP_WORDS)).alias("terms")
    )


def ngrams_1_2(spark, sf_dir):
    grams = T.unigrams_and_bigrams(T.terms(F.col("text"), C.STOP_WORDS))
    return C.documents(spark, sf_dir).select("doc_id", F.array_join(grams, "|").alias("ngrams"))


def ascii_clean(spark, sf_dir):
    return C.documents(spark, sf_dir).select("doc_id", T.ascii_clean(F.col("text")).alias("cleaned"))


def doc_frequency(spark, sf_dir):
    frequencies = tfidf.term_frequencies(C.documents(spark, sf_dir), ["doc_id"], "text", C.STOP_WORDS)
    return tfidf.doc_frequency(frequencies)


def tfidf_all(spark, sf_dir):
    rows = tfidf.tfidf(C.documents(spark, sf_dir), "doc_id", "text", C.STOP_WORDS)
    return rows.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def vocab_limit(spark, sf_dir):
    return tfidf.group_vocabulary(C.documents(spark, sf_dir), "lang", "doc_id", "text", C.STOP_WORDS)


def _group_weights(spark, sf_dir):
    return tfidf.tfidf_by_group(C.documents(spark, sf_dir), "lang", "doc_id", "text", C.STOP_WORDS)


def tfidf_by_group(spark, sf_dir):
    return _group_weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


def term_score_sum(spark, sf_dir):
    return keywords.term_scores(_group_weights(spark, sf_dir), "lang").withColumn("score", F.round("score", 6))


def _keywords(spark, sf_dir, top_n=C.KEYWORD_TOP):
    return keywords.cluster_keywords(
        C.documents(spark, sf_dir), "lang", "doc_id", "text", top_n, stop_words=C.STOP_WORDS
    )


def cluster_keywords(spark, sf_dir):
    return _keywords(spark, sf_dir).withColumn("score", F.round("score", 6))


def top_keywords_per_cluster(spark, sf_dir):
    return _keywords(spark, sf_dir, 10).select("lang", "rank", "term")


def keyword_line(spark, sf_dir):
    nested = keywords.nested_keywords(_keywords(spark, sf_dir), "lang")
    return nested.select("lang", T.keyword_line(F.col("keywords")).alias("keyword_line"))


def attach_keywords(spark, sf_dir):
    insights = C.documents(spark, sf_dir).select(F.concat("lang", F.when(F.col("doc_id") % 9 == 0, "-x").otherwise("")).alias("lang"))
    attached = report.attach_keywords(insights.distinct(), _keywords(spark, sf_dir), "lang")
    return attached.select("lang", F.size("keywords").cast("bigint").alias("n"), F.get("keywords", 0)["term"].alias("best"))


def _seed_ids(docs):
    first = docs.filter(F.col("lang") == "en").select("doc_id").orderBy("doc_id").limit(3)
    return [row["doc_id"] for row in first.collect()]


def _kmeans_inputs(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    vectors, dictionary = tfidf.tfidf_vectors(docs, "doc_id", "text", C.STOP_WORDS)
    ids = _seed_ids(docs)
    vectors = cut_lineage(vectors)
    return vectors, dictionary, ids, kmeans.centroids_from_documents(vectors, ids, "doc_id")


def assign_to_centroids(spark, sf_dir):
    vectors, _, ids, centroids = _kmeans_inputs(spark, sf_dir)
    labels = kmeans.assign_to_centroids(vectors, centroids, len(ids), "doc_id")
    return labels.select("doc_id", F.col("cluster").cast("bigint").alias("cluster"), F.round("cost", 6).alias("cost"))


def update_centroids(spark, sf_dir):
    vectors, dictionary, ids, centroids = _kmeans_inputs(spark, sf_dir)
    labels = kmeans.assign_to_centroids(vectors, centroids, len(ids), "doc_id")
    rows = kmeans.centroid_rows(kmeans.update_centroids(vectors, labels, len(ids), "doc_id"), dictionary)
    return rows.select(F.col("cluster").cast("bigint").alias("cluster"), "term", F.round("weight", 6).alias("weight"))


def lloyd_rounds(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    labels = kmeans.lloyd_kmeans(
        docs, max_iter=2, id_col="doc_id", text_col="text", stop_words=C.STOP_WORDS, start_ids=_seed_ids(docs)
    )
    return labels.select("doc_id", F.col("cluster").cast("bigint").alias("cluster"))


def kmeans_cluster(spark, sf_dir):
    """Clusters in the operator's own way: seeds of its own, rounds until the centroids rest."""
    labelled = kmeans.kmeans_cluster(C.documents(spark, sf_dir), 3, KMEANS_SEED, "doc_id", "text", C.STOP_WORDS)
    return labelled.select("doc_id", F.col("cluster").cast("bigint").alias("cluster"))


def polarity(spark, sf_dir):
    score = sentiment.polarity(F.col("text"), C.LEXICON, C.NEGATORS)
    return C.documents(spark, sf_dir).select("doc_id", F.round(score, 6).alias("polarity"))


def polarity_with_phrases(spark, sf_dir):
    """Phrases, negators and intensifiers, one plain word between them allowed."""
    score = sentiment.polarity(F.col("text"), C.PHRASES, C.NEGATORS, C.INTENSIFIERS, 1)
    return C.documents(spark, sf_dir).select("doc_id", F.round(score, 6).alias("polarity"))


def polarity_by_join(spark, sf_dir):
    lexicon = spark.createDataFrame(list(C.LEXICON.items()), "word string, polarity double")
    negators = spark.createDataFrame([(word,) for word in C.NEGATORS], "word string")
    rows = sentiment.polarity_from_tables(C.documents(spark, sf_dir), "doc_id", "text", lexicon, negators)
    return rows.select("doc_id", F.round("polarity", 6).alias("polarity"))


def polarity_from_tables(spark, sf_dir):
    """Every word of the lexicon stands in it twice, with polarities that differ."""
    twice = [(word, score + by) for word, score in C.LEXICON.items() for by in (-0.25, 0.25)]
    lexicon = spark.createDataFrame(twice, "word string, polarity double")
    negators = spark.createDataFrame([(word,) for word in C.NEGATORS * 2], "word string")
    rows = sentiment.polarity_from_tables(C.table(spark, sf_dir, "conversations"), "conv_id", "text", lexicon, negators)
    return rows.select("conv_id", F.round("polarity", 6).alias("polarity"))


def sentiment_label(spark, sf_dir):
    labelled = sentiment.with_sentiment(C.documents(spark, sf_dir), "text", C.LEXICON, C.NEGATORS)
    return labelled.select("doc_id", "sentiment")


def with_sentiment(spark, sf_dir):
    turns = C.table(spark, sf_dir, "conversations")
    return sentiment.with_sentiment(turns, "text", C.LEXICON, C.NEGATORS).select("conv_id", "turn", "sentiment")


def apply_text_fn(spark, sf_dir):
    def backwards(value):
        return value.strip().lower()[::-1]

    return sentiment.apply_text_fn(C.documents(spark, sf_dir), backwards, "text", "reversed").select("doc_id", "reversed")


def distinct_clusters(spark, sf_dir):
    return grouping.distinct_clusters(C.documents(spark, sf_dir), "lang")


def _ungrouped(spark, sf_dir):
    """Documents of which the Spanish ones have no group."""
    return C.documents(spark, sf_dir).withColumn("lang", F.nullif("lang", F.lit("es")))


def _groups(spark, sf_dir):
    return grouping.group_responses(_ungrouped(spark, sf_dir), "lang", "doc_id", "text", PART_CHARS)


def group_responses(spark, sf_dir):
    return _groups(spark, sf_dir).select("lang", "part", "n", F.md5(F.array_join("responses", "|")).alias("digest"))


def cluster_prompt(spark, sf_dir):
    messages = prompts.cluster_messages(_groups(spark, sf_dir), C.SURVEY, C.QUESTION, "lang")
    return messages.select("lang", "part", F.md5(F.col("messages")[1]["content"]).alias("digest"))


def chat_messages(spark, sf_dir):
    prompt = F.concat(F.lit("Item "), "text")
    messages = prompts.chat_messages(prompts.CLUSTER_ROLE, prompt)
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(messages).alias("m"))
    return rows.select("conv_id", "turn", "m.role", "m.content")


def strip_json_fence(spark, sf_dir):
    return C.replies(spark, sf_dir).select("cluster", T.strip_json_fence(F.col("reply")).alias("reply"))


def _parsed(spark, sf_dir):
    return C.replies(spark, sf_dir).select("cluster", parse_insight(F.col("cluster"), F.col("reply")).alias("parsed"))


def parse_insight_query(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "cluster", "parsed.title", "parsed.insight", F.array_join("parsed.actions", "|").alias("actions")
    )


def cluster_title(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "cluster", T.cluster_title(F.col("cluster"), F.col("parsed.title")).alias("title")
    )


def bullet_join(spark, sf_dir):
    return _parsed(spark, sf_dir).select("cluster", T.bullet_join(F.col("parsed.actions")).alias("actions"))


def order_by_cluster(spark, sf_dir):
    return _parsed(spark, sf_dir).select("cluster", "parsed.title").orderBy("cluster")


def _report(spark, sf_dir):
    """One report section per document, with the keywords of its language."""
    members = C.documents(spark, sf_dir).select(F.col("doc_id").alias("cluster"), "lang")
    named = members.join(_keywords(spark, sf_dir), "lang").select("cluster", "rank", "term", "score")
    return report.build_report(_parsed(spark, sf_dir), named, "cluster")


def build_report(spark, sf_dir):
    return _report(spark, sf_dir)


def write_report(spark, sf_dir):
    """Written as text and read back."""
    path = C.new_folder(spark)
    report.write_report(_report(spark, sf_dir), path, C.SURVEY, C.QUESTION)
    return spark.read.text(path).select(F.col("value").alias("line"))


def read_responses_csv(spark, sf_dir):
    """The documents written as quoted CSV files and read as answers."""
    path = C.new_folder(spark)
    texts = C.documents(spark, sf_dir).select("doc_id", F.col("text").alias("Response"))
    options = {"quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    texts.write.options(header=True, **options).csv(path)
    return R.read_responses_csv(spark, path).select(F.md5("response").alias("digest"))


def complete_query(spark, sf_dir):
    groups = cut_lineage(_groups(spark, sf_dir))
    replies = complete(
        prompts.cluster_messages(groups, C.SURVEY, C.QUESTION, "lang"), _counting_model(), temperature=0.5
    )
    return replies.select("lang", "part", "reply", "error")


def _counting_model():
    """Stands in for a model: answers with the size of the prompt, or fails.

    Nested, so that it travels to the workers by value.
    """

    def make_client():
        def client(messages, temperature):
            size = sum(len(message["content"]) for message in messages)
            if size % 4 == 3:
                raise ValueError("no answer")
            return f"{size} characters at {temperature}"

        return client

    return make_client


def _theme_model():
    """Stands in for a model: a title from the size of the answers, one action."""

    def make_client():
        def client(messages, temperature):
            answers = messages[1]["content"].split("\nAnswers:\n", 1)[1]
            if "Theme of" not in answers and len(answers) % 7 == 3:
                raise ValueError("no answer")
            return '```json\n{"title": "Theme of %d", "insight": "All of it", "actions": ["Act"]}\n```' % len(answers)

        return client

    return make_client


def summarize_clusters_query(spark, sf_dir):
    insights = summarize_clusters(
        _ungrouped(spark, sf_dir), C.SURVEY, C.QUESTION, _theme_model(), "lang", "doc_id", "text", PART_CHARS
    )
    return insights.select("lang", "parsed.title", "parsed.insight", F.array_join("parsed.actions", "|").alias("actions"), "error")


QUERIES = {
    "read_responses": read_responses,
    "drop_null_responses": drop_null_responses,
    "strip_nonblank": strip_nonblank,
    "split_responses": split_responses,
    "lines_until_marker": lines_until_marker,
    "filter_cluster": filter_cluster,
    "tokenize_words": tokenize_words,
    "tokenize_terms": tokenize_terms,
    "remove_stop_words": remove_stop_words,
    "ngrams_1_2": ngrams_1_2,
    "ascii_clean": ascii_clean,
    "doc_frequency": doc_frequency,
    "tfidf": tfidf_all,
    "vocab_limit": vocab_limit,
    "tfidf_by_group": tfidf_by_group,
    "term_score_sum": term_score_sum,
    "cluster_keywords": cluster_keywords,
    "top_keywords_per_cluster": top_keywords_per_cluster,
    "keyword_line": keyword_line,
    "attach_keywords": attach_keywords,
    "assign_to_centroids": assign_to_centroids,
    "update_centroids": update_centroids,
    "lloyd_rounds": lloyd_rounds,
    "kmeans_cluster": kmeans_cluster,
    "polarity": polarity,
    "polarity_with_phrases": polarity_with_phrases,
    "polarity_by_join": polarity_by_join,
    "polarity_from_tables": polarity_from_tables,
    "sentiment_label": sentiment_label,
    "with_sentiment": with_sentiment,
    "apply_text_fn": apply_text_fn,
    "distinct_clusters": distinct_clusters,
    "group_responses": group_responses,
    "cluster_prompt": cluster_prompt,
    "chat_messages": chat_messages,
    "strip_json_fence": strip_json_fence,
    "parse_insight": parse_insight_query,
    "cluster_title": cluster_title,
    "bullet_join": bullet_join,
    "order_by_cluster": order_by_cluster,
    "build_report": build_report,
    "complete": complete_query,
    "summarize_clusters": summarize_clusters_query,
    "write_report": write_report,
    "read_responses_csv": read_responses_csv,
}

PADDED = "' ' || chr(160) || chr(9) || text || chr(10) || chr(8232) || ' '"


def _polarity_sql(ids: str, source: str) -> str:
    return f"""
SELECT k.id1, k.id2, round(coalesce(avg(CASE WHEN k.word IN ({C.in_list(C.LEXICON)}) THEN
    (CASE k.word {' '.join(f"WHEN '{w}' THEN {p}" for w, p in C.LEXICON.items())} END)
    * (CASE WHEN k.before IN ({C.in_list(C.NEGATORS)}) THEN -0.5 ELSE 1.0 END) END::DOUBLE), 0.0), 9) AS polarity
FROM (SELECT id1, id2, word, lag(word) OVER (PARTITION BY id1, id2 ORDER BY pos) AS before
      FROM (SELECT id1, id2, unnest(words) AS word, generate_subscripts(words, 1) AS pos
            FROM (SELECT {ids}, {C.SQL_WORDS} AS words FROM {source}))) AS k
GROUP BY 1, 2"""


DOC_POLARITY = _polarity_sql("doc_id AS id1, 0 AS id2", "documents")
TURN_POLARITY = _polarity_sql("conv_id AS id1, turn AS id2", "conversations")
LABEL = "CASE WHEN {p} > 0.1 THEN 'Positive' WHEN {p} < -0.1 THEN 'Negative' ELSE 'Neutral' END"

# The answers of Spanish documents have no group.
SQL_PARTS = f"""
pieces AS (SELECT nullif(lang, 'es') AS lang, doc_id, i AS piece, substr(text, i * {PART_CHARS - 3} + 1, {PART_CHARS - 3}) AS text
  FROM documents, LATERAL (SELECT unnest(range(greatest(1, CAST(ceil(length(text) / {PART_CHARS - 3}.0) AS BIGINT)))) AS i)),
parts AS (SELECT lang, doc_id, piece, text, CAST(floor(
    (sum(length(text) + 3) OVER (PARTITION BY lang ORDER BY doc_id, piece ROWS UNBOUNDED PRECEDING) - length(text) - 3) / {PART_CHARS}
  ) AS BIGINT) AS part FROM pieces),
grouped AS (SELECT lang, part, count(*) AS n, list(text ORDER BY doc_id, piece) AS responses FROM parts GROUP BY 1, 2)"""
_task = prompts.CLUSTER_TASK.replace("'", "''")
SQL_PROMPT = (
    f"'{_task}' || chr(10) || chr(10) || 'Survey: {C.SURVEY}' || chr(10) || 'Question: {C.QUESTION}' || chr(10) || "
    "'Cluster: ' || coalesce(lang, 'none') || chr(10) || 'Answers:' || chr(10) || '- ' || array_to_string(responses, chr(10) || '- ')"
)
SQL_SEEDS = f"""{C.SQL_TFIDF},
seeds AS ({SEED_SQL}),
c0 AS (SELECT cluster, term, weight AS c FROM x JOIN seeds USING (doc_id))"""


def _assign_sql(centroids: str, out: str) -> str:
    return f"""
{out}_norms AS (SELECT s.cluster, coalesce(sum(c * c), 0) AS norm FROM seeds AS s LEFT JOIN {centroids} USING (cluster) GROUP BY 1),
{out}_dots AS (SELECT doc_id, cluster, sum(weight * c) AS dot FROM x JOIN {centroids} USING (term) GROUP BY 1, 2),
{out} AS (SELECT d.doc_id, n.cluster, round(n.norm - 2 * coalesce(dot, 0), 9) AS cost
  FROM documents AS d CROSS JOIN {out}_norms AS n LEFT JOIN {out}_dots AS t ON t.doc_id = d.doc_id AND t.cluster = n.cluster
  QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY cost, n.cluster) = 1)"""


def _update_sql(labels: str, out: str) -> str:
    return f"""
{out}_sizes AS (SELECT cluster, count(*) AS size FROM {labels} GROUP BY 1),
{out} AS (SELECT cluster, term, sum(weight) / any_value(size) AS c
  FROM x JOIN {labels} USING (doc_id) JOIN {out}_sizes USING (cluster) GROUP BY 1, 2)"""


def _draw_sql(step: int) -> str:
    digest = f"md5('{KMEANS_SEED + step}:' || doc_id)"
    return f"ln((CAST('0x' || substr({digest}, 1, 13) AS BIGINT) + 1) / {float(1 << 52)!r})"


def _candidates_sql(step: int) -> str:
    """How far each document is from the candidates so far; and, after them, the winners of the next race."""
    more = "" if step == kmeans.PASSES else f""",
cand{step + 1} AS (SELECT doc_id, ci FROM cand{step} UNION ALL
  SELECT doc_id, (SELECT count(*) FROM cand{step}) + row_number() OVER (ORDER BY time, doc_id) - 1 FROM (
    SELECT doc_id, -{_draw_sql(step + 1)} / round(cost + own, 8) AS time FROM near{step} JOIN own USING (doc_id)
    WHERE round(cost + own, 8) > 0 ORDER BY time, doc_id LIMIT {kmeans.OVERSAMPLE * 3}))"""
    return f"""
near{step} AS (SELECT doc_id, min(cost) AS cost, arg_min(ci, ROW(cost, ci)) AS ci FROM (
  SELECT d.doc_id, n.ci, round(n.own - 2 * coalesce(dot, 0), 9) AS cost
  FROM own AS d CROSS JOIN (SELECT ci, own FROM cand{step} JOIN own USING (doc_id)) AS n
  LEFT JOIN (SELECT a.doc_id, c.ci, sum(a.weight * b.weight) AS dot FROM x AS a JOIN x AS b USING (term)
             JOIN cand{step} AS c ON c.doc_id = b.doc_id GROUP BY 1, 2) AS t ON t.doc_id = d.doc_id AND t.ci = n.ci) GROUP BY 1){more}"""


def _pick_sql(step: int) -> str:
    """The candidate that wins the race of its weight and its distance to those picked before."""
    before = " UNION ALL ".join(f"SELECT ci FROM pick{i}" for i in range(step))
    mass = "CAST(w AS DOUBLE)" if not step else f"w * (SELECT min(apart) FROM apart WHERE apart.a = m.ci AND apart.b IN ({before}))"
    return f"""
pick{step} AS (SELECT ci, doc_id FROM (SELECT m.ci, m.doc_id, {mass} AS mass FROM masses AS m) WHERE mass > 0
  ORDER BY -{_draw_sql(kmeans.PASSES + 1 + step)} / mass, doc_id LIMIT 1)"""


# More rounds than the small tables take to rest; after that they change nothing.
_REST = 30
_LAST = kmeans.PASSES
_SQL_KMEANS = f"""own AS (SELECT doc_id, sum(weight * weight) AS own FROM x GROUP BY 1),
cand0 AS (SELECT doc_id, 0 AS ci FROM own ORDER BY -{_draw_sql(0)}, doc_id LIMIT 1),
{', '.join(_candidates_sql(i) for i in range(_LAST + 1))},
masses AS (SELECT c.ci, c.doc_id, count(n.doc_id) AS w FROM cand{_LAST} AS c LEFT JOIN near{_LAST} AS n USING (ci) GROUP BY 1, 2),
apart AS (SELECT a.ci AS a, b.ci AS b, round(oa.own + ob.own - 2 * coalesce(sum(xa.weight * xb.weight), 0), 8) AS apart
  FROM cand{_LAST} AS a CROSS JOIN cand{_LAST} AS b JOIN own AS oa ON oa.doc_id = a.doc_id JOIN own AS ob ON ob.doc_id = b.doc_id
  LEFT JOIN x AS xa ON xa.doc_id = a.doc_id LEFT JOIN x AS xb ON xb.doc_id = b.doc_id AND xb.term = xa.term GROUP BY a.ci, b.ci, oa.own, ob.own),
{', '.join(_pick_sql(i) for i in range(3))},
seeds AS (SELECT doc_id, 0 AS cluster FROM pick0 UNION ALL SELECT doc_id, 1 FROM pick1 UNION ALL SELECT doc_id, 2 FROM pick2),
c0 AS (SELECT cluster, term, weight AS c FROM x JOIN seeds USING (doc_id)),
{', '.join(f"{_assign_sql(f'c{i}', f'a{i}')}, {_update_sql(f'a{i}', f'c{i + 1}')}" for i in range(_REST))},
{_assign_sql(f'c{_REST}', f'a{_REST}')}"""
_size_sql = f"length('{prompts.CLUSTER_ROLE}') + length({SQL_PROMPT})"

SQL = {
    "read_responses": "SELECT doc_id AS response_id, text AS response FROM documents",
    "drop_null_responses": "SELECT conv_id, turn, text AS response FROM conversations WHERE turn % 3 <> 0 AND text IS NOT NULL",
    "strip_nonblank": f"SELECT doc_id, {C.sql_strip(PADDED)} AS response FROM documents WHERE doc_id % 5 <> 0 AND {C.sql_strip('text')} <> ''",
    "split_responses": f"SELECT doc_id, line_no, {C.sql_strip('line')} AS response FROM ({C.SQL_LINES}) WHERE {C.sql_strip('line')} <> ''",
    "lines_until_marker": f"""
        WITH l AS (SELECT doc_id, line_no, CASE WHEN (line_no + doc_id) % 7 = 5 THEN 'END' ELSE {C.sql_strip('line')} END AS line
                   FROM ({C.SQL_LINES})),
        s AS (SELECT doc_id, min(line_no) AS stop FROM l WHERE upper(line) = 'END' GROUP BY 1)
        SELECT doc_id, line_no, line FROM l LEFT JOIN s USING (doc_id) WHERE line <> '' AND line_no < coalesce(stop, 1000000000)""",
    "filter_cluster": "SELECT doc_id, text FROM documents WHERE lang = 'de'",
    "tokenize_words": f"SELECT doc_id, array_to_string({C.SQL_WORDS}, ' ') AS words FROM documents",
    "tokenize_terms": r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), ' ') AS terms FROM documents",
    "remove_stop_words": f"SELECT doc_id, array_to_string({C.SQL_TERMS}, ' ') AS terms FROM documents",
    "ngrams_1_2": f"SELECT doc_id, array_to_string({C.SQL_NGRAMS}, '|') AS ngrams FROM documents",
    "ascii_clean": f"SELECT doc_id, {C.sql_ascii_clean('text')} AS cleaned FROM documents",
    "doc_frequency": f"WITH {C.SQL_TFIDF} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1",
    "tfidf": f"WITH {C.SQL_TFIDF} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM x",
    "vocab_limit": f"WITH {C.SQL_GROUP_VOCABULARY} SELECT lang, term, CAST(n AS BIGINT) AS n, df FROM gd",
    "tfidf_by_group": f"WITH {C.SQL_GROUP_TFIDF} SELECT lang, doc_id, term, tf, round(weight, 6) AS weight FROM gx",
    "term_score_sum": f"WITH {C.SQL_KEYWORDS} SELECT lang, term, round(score, 6) AS score FROM scores",
    "cluster_keywords": f"WITH {C.SQL_KEYWORDS} SELECT lang, rank, term, round(score, 6) AS score FROM kw",
    "top_keywords_per_cluster": f"WITH {C.SQL_KEYWORDS} SELECT lang, rank, term FROM kw WHERE rank <= 10",
    "keyword_line": f"WITH {C.SQL_KEYWORDS} SELECT lang, 'Top Keywords: ' || string_agg(term, ', ' ORDER BY rank) AS keyword_line FROM kw GROUP BY 1",
    "attach_keywords": f"""
        WITH {C.SQL_KEYWORDS},
        i AS (SELECT DISTINCT lang || CASE WHEN doc_id % 9 = 0 THEN '-x' ELSE '' END AS lang FROM documents)
        SELECT lang, count(term) AS n, min_by(term, rank) AS best FROM i LEFT JOIN kw USING (lang) GROUP BY 1""",
    "assign_to_centroids": f"WITH {SQL_SEEDS}, {_assign_sql('c0', 'a0')} SELECT doc_id, cluster, round(cost, 6) AS cost FROM a0",
    "update_centroids": f"WITH {SQL_SEEDS}, {_assign_sql('c0', 'a0')}, {_update_sql('a0', 'c1')} SELECT cluster, term, round(c, 6) AS weight FROM c1",
    "lloyd_rounds": f"""WITH {SQL_SEEDS}, {_assign_sql('c0', 'a0')}, {_update_sql('a0', 'c1')},
        {_assign_sql('c1', 'a1')}, {_update_sql('a1', 'c2')}, {_assign_sql('c2', 'a2')} SELECT doc_id, cluster FROM a2""",
    "polarity": f"SELECT d.doc_id, round(coalesce(polarity, 0.0), 6) AS polarity FROM documents AS d LEFT JOIN ({DOC_POLARITY}) AS s ON s.id1 = d.doc_id",
    # The state of each document goes from token to token; all documents take a step at once.
    "polarity_with_phrases": f"""
        WITH RECURSIVE t AS (SELECT doc_id, {C.SQL_WORDS} AS w FROM documents),
        lex(entry, size, score) AS (VALUES {', '.join(f"('{e}', {len(e.split())}, CAST({v} AS DOUBLE))" for e, v in C.PHRASES.items())}),
        mods(word, factor) AS (VALUES {', '.join(f"('{e}', CAST({v} AS DOUBLE))" for e, v in C.INTENSIFIERS.items())}),
        tok AS (SELECT doc_id, i, w[i] AS word, array_to_string(w[i:i + 1], ' ') AS two, array_to_string(w[i:i + 2], ' ') AS three
                FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
        ev AS (SELECT doc_id, i, coalesce(c.score, b.score, a.score) AS score, coalesce(c.size, b.size, 1) AS size,
                 tok.word IN ({C.in_list(C.NEGATORS)}) AS negates, factor
               FROM tok LEFT JOIN lex AS a ON a.entry = tok.word LEFT JOIN lex AS b ON b.entry = two AND b.size = 2
               LEFT JOIN lex AS c ON c.entry = three AND c.size = 3 LEFT JOIN mods AS m ON m.word = tok.word),
        run(doc_id, i, skip, factor, sign, gap, total, n) AS (
          SELECT doc_id, 1, 0, 1.0::DOUBLE, 1.0::DOUBLE, 0, 0.0::DOUBLE, 0 FROM t
          UNION ALL
          SELECT r.doc_id, r.i + 1,
            CASE WHEN r.skip > 0 THEN r.skip - 1 WHEN e.score IS NOT NULL THEN e.size - 1 ELSE 0 END,
            CASE WHEN r.skip > 0 OR e.negates AND e.score IS NULL THEN r.factor WHEN e.score IS NOT NULL THEN 1.0
              WHEN e.factor IS NOT NULL THEN r.factor * e.factor WHEN r.gap < 1 THEN 1 + (r.factor - 1) * 0.5 ELSE 1.0 END,
            CASE WHEN r.skip > 0 THEN r.sign WHEN e.score IS NOT NULL THEN 1.0 WHEN e.negates THEN -0.5
              WHEN e.factor IS NOT NULL OR r.gap < 1 THEN r.sign ELSE 1.0 END,
            CASE WHEN r.skip > 0 THEN r.gap WHEN e.score IS NOT NULL OR e.negates OR e.factor IS NOT NULL OR r.gap >= 1 THEN 0 ELSE r.gap + 1 END,
            r.total + CASE WHEN r.skip = 0 AND e.score IS NOT NULL THEN greatest(-1.0, least(1.0, e.score * r.factor * r.sign)) ELSE 0.0 END,
            r.n + CASE WHEN r.skip = 0 AND e.score IS NOT NULL THEN 1 ELSE 0 END
          FROM run AS r JOIN ev AS e ON e.doc_id = r.doc_id AND e.i = r.i)
        SELECT doc_id, round(CASE WHEN arg_max(n, i) > 0 THEN arg_max(total, i) / arg_max(n, i) ELSE 0.0 END, 6) AS polarity FROM run GROUP BY 1""",
    "polarity_by_join": f"SELECT d.doc_id, round(coalesce(polarity, 0.0), 6) AS polarity FROM documents AS d LEFT JOIN ({DOC_POLARITY}) AS s ON s.id1 = d.doc_id",
    "polarity_from_tables": f"SELECT d.conv_id, round(coalesce(polarity, 0.0), 6) AS polarity FROM conversations AS d LEFT JOIN ({TURN_POLARITY}) AS s ON s.id1 = d.conv_id AND s.id2 = d.turn",
    "sentiment_label": f"SELECT d.doc_id, {LABEL.format(p='coalesce(polarity, 0.0)')} AS sentiment FROM documents AS d LEFT JOIN ({DOC_POLARITY}) AS s ON s.id1 = d.doc_id",
    "with_sentiment": f"SELECT d.conv_id, d.turn, {LABEL.format(p='coalesce(polarity, 0.0)')} AS sentiment FROM conversations AS d LEFT JOIN ({TURN_POLARITY}) AS s ON s.id1 = d.conv_id AND s.id2 = d.turn",
    "apply_text_fn": f"SELECT doc_id, array_to_string(list_reverse(string_split(lower({C.sql_strip('text')}), '')), '') AS reversed FROM documents",
    "distinct_clusters": "SELECT DISTINCT lang FROM documents",
    "group_responses": f"WITH {SQL_PARTS} SELECT lang, part, n, md5(array_to_string(responses, '|')) AS digest FROM grouped",
    "cluster_prompt": f"WITH {SQL_PARTS} SELECT lang, part, md5({SQL_PROMPT}) AS digest FROM grouped",
    "chat_messages": f"""
        SELECT conv_id, turn, 'system' AS role, '{prompts.CLUSTER_ROLE}' AS content FROM conversations
        UNION ALL SELECT conv_id, turn, 'user', 'Item ' || text FROM conversations""",
    "strip_json_fence": f"""
        SELECT cluster, CASE WHEN starts_with({C.sql_strip('reply')}, '```json')
          THEN {C.sql_strip("replace(replace(reply, '```json', ''), '```', '')")} ELSE {C.sql_strip('reply')} END AS reply
        FROM ({C.SQL_REPLIES})""",
    "parse_insight": f"SELECT cluster, title, insight, array_to_string(actions, '|') AS actions FROM ({C.SQL_PARSED})",
    "cluster_title": f"SELECT cluster, 'Cluster ' || cluster || ' - ' || title AS title FROM ({C.SQL_PARSED})",
    "bullet_join": f"SELECT cluster, '- ' || array_to_string(actions, chr(10) || '- ') AS actions FROM ({C.SQL_PARSED})",
    "order_by_cluster": f"SELECT cluster, title FROM ({C.SQL_PARSED}) ORDER BY cluster",
    "build_report": f"""
        WITH {C.SQL_KEYWORDS}, lines AS (SELECT lang, 'Top Keywords: ' || string_agg(term, ', ' ORDER BY rank) AS keyword_line FROM kw GROUP BY 1)
        SELECT cluster, {C.sql_ascii_clean("'Cluster ' || cluster || ' - ' || title")} AS title,
          {C.sql_ascii_clean("'Insights:' || chr(10) || insight || chr(10) || chr(10) || 'Action Suggestions:' || chr(10) || '- ' || array_to_string(actions, chr(10) || '- ')")} AS body,
          keyword_line
        FROM ({C.SQL_PARSED}) JOIN documents ON doc_id = cluster JOIN lines USING (lang)""",
    "read_responses_csv": "SELECT md5(text) AS digest FROM documents",
    "complete": f"""
        WITH {SQL_PARTS}, sized AS (SELECT lang, part, {_size_sql} AS size FROM grouped)
        SELECT lang, part, CASE WHEN size % 4 <> 3 THEN size || ' characters at 0.5' END AS reply,
          CASE WHEN size % 4 = 3 THEN 'ValueError: no answer' END AS error FROM sized""",
    "kmeans_cluster": f"""WITH {C.SQL_TFIDF}, {_SQL_KMEANS},
        first_ids AS (SELECT cluster, row_number() OVER (ORDER BY min(doc_id)) - 1 AS renamed FROM a{_REST} GROUP BY 1)
        SELECT doc_id, renamed AS cluster FROM a{_REST} JOIN first_ids USING (cluster)""",
    # Groups of up to 64 parts: the parts, every eight of them, every eight of those.
    "summarize_clusters": f"""
        WITH {SQL_PARTS},
        sized AS (SELECT lang, part, 2 + length(array_to_string(responses, chr(10) || '- ')) AS size FROM grouped),
        r0 AS (SELECT lang, part, CASE WHEN size % 7 <> 3 THEN 'Theme of ' || size END AS title FROM sized),
        n0 AS (SELECT lang, count(*) AS parts, count(title) AS good, max(title) AS title FROM r0 GROUP BY 1),
        r1 AS (SELECT r0.lang, part // 8 AS part, 'Theme of ' || CAST(sum(length(r0.title) + 19) - 1 AS BIGINT) AS title
               FROM r0 JOIN n0 ON n0.lang IS NOT DISTINCT FROM r0.lang WHERE parts > 1 AND r0.title IS NOT NULL GROUP BY 1, 2),
        n1 AS (SELECT lang, count(*) AS parts, max(title) AS title, CAST(sum(length(title) + 19) - 1 AS BIGINT) AS size FROM r1 GROUP BY 1)
        SELECT n0.lang,
          coalesce(CASE WHEN n1.parts = 1 THEN n1.title WHEN n1.parts > 1 THEN 'Theme of ' || n1.size ELSE n0.title END,
                   'Cluster ' || coalesce(n0.lang, 'none') || ' - Undefined') AS title,
          CASE WHEN good > 0 THEN 'All of it' ELSE 'Insight could not be generated.' END AS insight,
          CASE WHEN good > 0 THEN 'Act' ELSE 'No actions available due to error.' END AS actions,
          CASE WHEN good < n0.parts THEN (n0.parts - good) || ' failed: ValueError: no answer' END AS error
        FROM n0 LEFT JOIN n1 ON n1.lang IS NOT DISTINCT FROM n0.lang""",
}
SQL["write_report"] = f"""
    SELECT unnest(['Customer Feedback Analysis Report', 'Survey: {C.SURVEY}', 'Question: {C.QUESTION}', '']) AS line
    UNION ALL SELECT unnest(string_split(title || chr(10) || body || chr(10) || keyword_line || chr(10), chr(10))) FROM ({SQL["build_report"]})"""
