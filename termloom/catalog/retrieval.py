"""Queries over text functions, the inverted index and retrieval.

Terms are the distinct part labels (name and brand, with part types as synonyms) or the
benchmark items; queries are all lines of all conversations and all part labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.catalog.common import scratch, sql_chars, sql_collapse, sql_ngrams, sql_strip, sql_words, table
from termloom.functions.text import context_query, normalize_name, strip_text, word_ngrams
from termloom.operators import index as I
from termloom.operators import retrieve as R
from termloom.operators.index import char_gram_counts
from termloom.operators.ontology import number_terms
from termloom.plans.staging import spread

PLACES = 6


def part_terms(spark: SparkSession, d: str) -> DataFrame:
    """One term per distinct part label."""
    label = F.concat_ws(" ", "p_name", "p_brand")
    return (
        table(spark, d, "part")
        .groupBy(label.alias("label"))
        .agg(F.min("p_partkey").alias("first_key"), F.sort_array(F.collect_set("p_type")).alias("synonyms"))
        .select(
            F.concat(F.lit("PART:"), F.col("first_key")).alias("id"),
            F.format_string("part/%012d", "first_key").alias("iri"),
            "label",
            "synonyms",
            F.lit("").alias("definition"),
            F.array(F.lit("PART:0")).alias("parents"),
        )
    )


_PART_TERMS = """
terms AS (
  SELECT row_number() OVER (ORDER BY first_key) - 1 AS term_no, 'PART:' || first_key AS id, label, synonyms, '' AS definition
  FROM (SELECT p_name || ' ' || p_brand AS label, min(p_partkey) AS first_key, list_sort(list(DISTINCT p_type)) AS synonyms
        FROM part GROUP BY 1))
"""


def benchmark_terms(spark: SparkSession, d: str) -> DataFrame:
    """One term per benchmark item, its whole text as definition."""
    return table(spark, d, "benchmark").select(
        F.concat(F.lit("ITEM:"), F.col("item_id")).alias("id"),
        F.format_string("item/%012d", "item_id").alias("iri"),
        F.concat(F.lit("item "), F.col("item_id")).alias("label"),
        F.array().cast("array<string>").alias("synonyms"),
        F.col("text").alias("definition"),
        F.array().cast("array<string>").alias("parents"),
    )


_BENCHMARK_TERMS = """
terms AS (
  SELECT row_number() OVER (ORDER BY item_id) - 1 AS term_no, 'ITEM:' || item_id AS id, 'item ' || item_id AS label,
         []::VARCHAR[] AS synonyms, text AS definition FROM benchmark)
"""


def asking_rows(spark: SparkSession, d: str) -> DataFrame:
    """(asks, query, field): every conversation line with its role, every part label in capitals, and what asks it."""
    lines = table(spark, d, "conversations").select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "query"), F.col("role").alias("field")
    )
    lines = lines.select(F.concat_ws("/", "conv_id", "turn", "line").alias("asks"), "query", "field")
    labels = table(spark, d, "part").select(
        F.concat_ws("/", F.lit("part"), "p_partkey").alias("asks"),
        F.upper(F.concat_ws("  ", "p_name", "p_brand")).alias("query"),
        F.lit("part_name").alias("field"),
    )
    return lines.unionByName(labels)


def all_asked(spark: SparkSession, d: str) -> DataFrame:
    """(query, field): every conversation line with its role, every part label in capitals."""
    return asking_rows(spark, d).drop("asks")


_ASKED = f"""
asked AS (
  SELECT DISTINCT {sql_strip('query')} AS query, field FROM (
    SELECT unnest(string_split(text, chr(10))) AS query, role AS field FROM conversations
    UNION ALL SELECT upper(p_name || '  ' || p_brand), 'part_name' FROM part)
  WHERE {sql_strip('query')} <> '')
"""

_TEXT = "label || ' ' || label || ' ' || array_to_string(synonyms, ' ; ') || ' ' || array_to_string(synonyms, ' ; ') || ' ' || definition"

_INDEX_SQL = f"""
texts AS (SELECT term_no, {_TEXT} AS text FROM terms),
words AS (SELECT term_no, {sql_words('text')} AS w, {sql_chars('text')} AS c FROM texts),
term_tokens AS (
  SELECT term_no, 'w' AS analyzer, unnest({sql_ngrams('w')}) AS token FROM words
  UNION ALL SELECT term_no, 'c', unnest(c) FROM words),
tf AS (SELECT term_no, analyzer, token, count(*) AS tf FROM term_tokens GROUP BY ALL),
vocab AS (
  SELECT analyzer, token, count(*) AS df,
         ln((1.0::DOUBLE + (SELECT count(*) FROM terms)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
  FROM tf GROUP BY ALL),
raw AS (SELECT term_no, analyzer, token, (1.0::DOUBLE + ln(tf::DOUBLE)) * idf AS raw FROM tf JOIN vocab USING (analyzer, token)),
postings AS (
  SELECT term_no, analyzer, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY term_no, analyzer)) AS w FROM raw)
"""

_SCORES_SQL = f"""
ctx AS (
  SELECT row_number() OVER () AS qid, query, field,
         CASE WHEN field <> '' THEN replace(field, '_', ' ') || ' ' || query ELSE query END AS context FROM asked),
query_words AS (
  SELECT qid, {sql_words('query')} AS w, {sql_words('context')} AS cw, {sql_chars('query')} AS c,
         {sql_chars('context')} AS cc FROM ctx),
query_tokens AS (
  SELECT qid, 'w' AS analyzer, 'v' AS channel, unnest({sql_ngrams('w')}) AS token FROM query_words
  UNION ALL SELECT qid, 'w', 'x', unnest({sql_ngrams('cw')}) FROM query_words
  UNION ALL SELECT qid, 'c', 'v', unnest(c) FROM query_words
  UNION ALL SELECT qid, 'c', 'x', unnest(cc) FROM query_words),
query_tf AS (SELECT qid, analyzer, channel, token, count(*) AS tf FROM query_tokens GROUP BY ALL),
query_raw AS (
  SELECT qid, analyzer, channel, token, (1.0::DOUBLE + ln(tf::DOUBLE)) * idf AS raw
  FROM query_tf JOIN vocab USING (analyzer, token)),
query_unit AS (
  SELECT qid, analyzer, channel, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY qid, analyzer, channel)) AS u FROM query_raw),
query_weight AS (
  SELECT qid, analyzer, token, sum(u * CASE WHEN analyzer = 'w' AND channel = 'v' THEN 0.45::DOUBLE
    WHEN analyzer = 'c' AND channel = 'v' THEN 0.35::DOUBLE WHEN analyzer = 'w' THEN 0.12::DOUBLE ELSE 0.08::DOUBLE END) AS qw
  FROM query_unit GROUP BY ALL),
names AS (
  SELECT DISTINCT term_no, {sql_collapse('lower(n)')} AS name
  FROM (SELECT term_no, unnest(list_concat([label], synonyms)) AS n FROM terms)),
parts AS (
  SELECT qid, term_no, qw * w AS s FROM query_weight JOIN postings USING (analyzer, token)
  UNION ALL SELECT qid, term_no, 1.0::DOUBLE FROM ctx JOIN names ON name = {sql_collapse('lower(query)')}),
scores AS (SELECT qid, term_no, sum(s) AS score FROM parts GROUP BY ALL)
"""


def _ranked_sql(k: int) -> str:
    return f"""
filled AS (
  SELECT ctx.qid, terms.term_no, coalesce(score, 0.0::DOUBLE) AS score
  FROM ctx CROSS JOIN terms LEFT JOIN scores ON scores.qid = ctx.qid AND scores.term_no = terms.term_no),
ranked AS (
  SELECT qid, term_no, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, term_no) AS rank FROM filled),
best AS (
  SELECT query, field, rank, round(score, 4) AS score, id, label FROM ranked
  JOIN ctx USING (qid) JOIN terms USING (term_no) WHERE rank <= {k})
"""


# ---------------------------------------------------------------- text functions


def word_grams(spark: SparkSession, d: str) -> DataFrame:
    texts = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    tokens = texts.select(F.explode(word_ngrams(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


WORD_GRAMS = f"""
SELECT token, count(*) AS n FROM (
  SELECT unnest({sql_ngrams('w')}) AS token FROM (SELECT {sql_words('text')} AS w FROM documents)) GROUP BY token
"""


def char_grams(spark: SparkSession, d: str) -> DataFrame:
    return char_gram_counts(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))


CHAR_GRAMS = f"SELECT token, count(*) AS n FROM (SELECT unnest({sql_chars('text')}) AS token FROM documents) GROUP BY token"


def names_normal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(normalize_name(F.col("text"))).alias("name_md5"))


NAMES_NORMAL = f"SELECT doc_id, md5({sql_collapse('lower(text)')}) AS name_md5 FROM documents"


def context_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("field", F.when(F.col("p_size") > 10, "isolation_source").otherwise(""))
    return rows.select("p_partkey", context_query(F.col("p_name"), F.col("field")).alias("context"))


CONTEXT = """
SELECT p_partkey, CASE WHEN p_size > 10 THEN 'isolation source ' || p_name ELSE p_name END AS context FROM part
"""


def term_texts(spark: SparkSession, d: str) -> DataFrame:
    return part_terms(spark, d).select("id", I.build_text(F.col("label"), F.col("synonyms"), F.col("definition")).alias("text"))


TERM_TEXTS = f"WITH {_PART_TERMS} SELECT id, {_TEXT} AS text FROM terms"


# ---------------------------------------------------------------- index


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    counted = I.term_frequencies(number_terms(benchmark_terms(spark, d))).filter(F.col("analyzer") != I.NAME)
    return counted.select("term_no", "analyzer", "token", F.round(I.term_frequency_weight(F.col("tf")), PLACES).alias("weight"))


TERM_FREQUENCIES = f"""
WITH {_BENCHMARK_TERMS}, {_INDEX_SQL}
SELECT term_no, analyzer, token, round(1.0::DOUBLE + ln(tf::DOUBLE), {PLACES}) AS weight FROM tf
"""


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    terms = number_terms(benchmark_terms(spark, d))
    vocab = I.build_vocab(I.term_frequencies(terms), terms.count()).filter(F.col("analyzer") != I.NAME)
    return vocab.select("analyzer", "token", "df", F.round("idf", PLACES).alias("idf"))


VOCABULARY = f"""
WITH {_BENCHMARK_TERMS}, {_INDEX_SQL} SELECT analyzer, token, df, round(idf, {PLACES}) AS idf FROM vocab
"""


def postings(spark: SparkSession, d: str) -> DataFrame:
    index = I.build_index(number_terms(benchmark_terms(spark, d)))
    return I.postings_rows(index).select("analyzer", "token", "term_no", F.round("w", PLACES).alias("w"))


POSTINGS = f"""
WITH {_BENCHMARK_TERMS}, {_INDEX_SQL} SELECT analyzer, token, term_no, round(w, {PLACES}) AS w FROM postings
"""


def saved_index(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary and postings sizes after saving and loading."""
    path = scratch(spark, "saved")
    I.save_index(I.build_index(number_terms(part_terms(spark, d))), path)
    loaded = I.load_index(spark, path)
    return I.postings_rows(loaded).groupBy("analyzer").agg(
        F.count("*").alias("postings"), F.count_distinct("token").alias("tokens"), F.count_distinct("term_no").alias("terms")
    )


SAVED_INDEX = f"""
WITH {_PART_TERMS}, {_INDEX_SQL}
SELECT analyzer, count(*) AS postings, count(DISTINCT token) AS tokens, count(DISTINCT term_no) AS terms FROM postings GROUP BY 1
"""


# ---------------------------------------------------------------- retrieval


def fused_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Every non-zero score, summed per query as a check of all of them."""
    index = I.build_index(number_terms(part_terms(spark, d)))
    asked = R.distinct_queries(all_asked(spark, d))
    scores = R.score_terms(asked, index).filter(F.col("term_no").isNotNull())
    return scores.groupBy("term_no").agg(F.count("*").alias("queries"), F.round(F.sum("score"), 4).alias("total"))


FUSED = f"""
WITH {_PART_TERMS}, {_ASKED}, {_INDEX_SQL}, {_SCORES_SQL}
SELECT term_no, count(*) AS queries, round(sum(score), 4) AS total FROM scores GROUP BY 1
"""


def _flat(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*keys, F.explode("candidates").alias("c")).select(
        *keys, F.col("c.rank").alias("rank"), F.col("c.score").alias("score"), F.col("c.id").alias("id"), F.col("c.label").alias("label")
    )


def _distinct_asked(spark: SparkSession, d: str) -> DataFrame:
    return R.distinct_queries(all_asked(spark, d)).select("query", "field")


def retrieve_top_k(spark: SparkSession, d: str) -> DataFrame:
    index = I.build_index(number_terms(part_terms(spark, d)))
    return _flat(R.retrieve(_distinct_asked(spark, d), index, k=5), "query", "field")


RETRIEVE = f"""
WITH {_PART_TERMS}, {_ASKED}, {_INDEX_SQL}, {_SCORES_SQL}, {_ranked_sql(5)} SELECT * FROM best
"""


def retrieve_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """An index over the limits: nothing else is broadcast, the postings are cut into shards, busy queries are salted.

    Every row asks, with its repeats, and a query of two rows is a busy one. A query is answered by the least of the lists
    that its rows got, so a row that is left without candidates, or with others, shows in the result.
    """
    index = I.build_index(number_terms(benchmark_terms(spark, d)), broadcast_bytes=0)
    shard_bytes = index.postings_bytes // 2
    found = R.retrieve(asking_rows(spark, d), index, k=8, broadcast_bytes=0, shard_bytes=shard_bytes, salt_rows=1)
    hits = F.transform("candidates", lambda c: F.struct(*(c[name].alias(name) for name in ("rank", "score", "id", "label"))))
    asked = strip_text(F.col("query")).alias("query"), F.coalesce("field", F.lit("")).alias("field")
    return _flat(found.groupBy(*asked).agg(F.min(hits).alias("candidates")), "query", "field")


RETRIEVE_SHUFFLED = f"""
WITH {_BENCHMARK_TERMS}, {_ASKED}, {_INDEX_SQL}, {_SCORES_SQL}, {_ranked_sql(8)} SELECT * FROM best
"""


def exact_names(spark: SparkSession, d: str) -> DataFrame:
    """Queries that equal a name of a term score above one."""
    index = I.build_index(number_terms(part_terms(spark, d)))
    found = _flat(R.retrieve(_distinct_asked(spark, d), index, k=1), "query", "field")
    return found.groupBy("field").agg(F.count_if(F.col("score") > 1).alias("exact"), F.count("*").alias("queries"))


EXACT = f"""
WITH {_PART_TERMS}, {_ASKED}, names AS (
  SELECT DISTINCT {sql_collapse('lower(n)')} AS name FROM (SELECT unnest(list_concat([label], synonyms)) AS n FROM terms))
SELECT field, count(name) AS exact, count(*) AS queries FROM asked LEFT JOIN names ON name = {sql_collapse('lower(query)')} GROUP BY 1
"""


def concepts_retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Concept rows with repeats and blank queries; every row keeps its place."""
    index = I.build_index(number_terms(part_terms(spark, d)))
    concepts = table(spark, d, "part").select(
        F.col("p_partkey").alias("rec_id"),
        F.when(F.col("p_size") > 45, " ").otherwise(F.concat_ws(" ", "p_name", "p_brand")).alias("normalized_query"),
        F.when(F.col("p_size") > 48, "").otherwise(F.col("p_type")).alias("raw_value"),
        F.lit("").alias("source_field"),
        F.col("p_type").alias("concept_type"),
    )
    found = R.retrieve_for_concepts(concepts, index, k=5)
    return found.select(
        "rec_id", F.size("candidates").alias("hits"), F.get("candidates", F.lit(0))["label"].alias("best")
    )


CONCEPTS = """
SELECT p_partkey AS rec_id, CASE WHEN p_size > 45 THEN 0 ELSE 5 END AS hits,
       CASE WHEN p_size <= 45 THEN p_name || ' ' || p_brand END AS best FROM part
"""


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """How many rows ask, and how many distinct queries are scored."""
    asked = all_asked(spark, d)
    scored = R.distinct_queries(asked).groupBy("field").agg(F.count("*").alias("scored"))
    rows = asked.groupBy("field").agg(F.count("*").alias("asking"))
    return rows.join(scored, "field")


DEDUPLICATED = f"""
WITH {_ASKED}
SELECT field, asking, scored FROM (
  SELECT field, count(*) AS asking FROM (
    SELECT unnest(string_split(text, chr(10))) AS query, role AS field FROM conversations
    UNION ALL SELECT p_name, 'part_name' FROM part) GROUP BY field)
JOIN (SELECT field, count(*) AS scored FROM asked GROUP BY field) USING (field)
"""


def hydrated(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with all their term columns."""
    index = I.build_index(number_terms(part_terms(spark, d)))
    labels = part_terms(spark, d).select(F.col("label").alias("query"), F.lit("").alias("field"))
    found = R.retrieve(labels, index, k=1).select("query", F.explode("candidates").alias("c"))
    return found.select(
        "query", "c.id", "c.iri", "c.label", F.array_join("c.synonyms", ",").alias("synonyms"), "c.definition",
        F.array_join("c.parents", ",").alias("parents"),
    )


HYDRATED = f"""
WITH {_PART_TERMS}
SELECT label AS query, id, printf('part/%012d', replace(id, 'PART:', '')::INT) AS iri, label,
       array_to_string(synonyms, ',') AS synonyms, definition, 'PART:0' AS parents FROM terms
"""

QUERIES = {
    "word_ngrams": word_grams,
    "char_ngrams": char_grams,
    "normalize_name": names_normal,
    "context_query": context_texts,
    "build_text": term_texts,
    "term_frequency": term_frequencies,
    "smooth_idf": vocabulary,
    "build_postings": postings,
    "save_load_index": saved_index,
    "fused_cosine": fused_cosine,
    "retrieve_top_k": retrieve_top_k,
    "retrieve_shuffled_index": retrieve_shuffled,
    "exact_name_bonus": exact_names,
    "retrieve_for_concepts": concepts_retrieved,
    "dedup_queries": deduplicated,
    "hydrate_hits": hydrated,
}
ORACLES = {
    "word_ngrams": WORD_GRAMS,
    "char_ngrams": CHAR_GRAMS,
    "normalize_name": NAMES_NORMAL,
    "context_query": CONTEXT,
    "build_text": TERM_TEXTS,
    "term_frequency": TERM_FREQUENCIES,
    "smooth_idf": VOCABULARY,
    "build_postings": POSTINGS,
    "save_load_index": SAVED_INDEX,
    "fused_cosine": FUSED,
    "retrieve_top_k": RETRIEVE,
    "retrieve_shuffled_index": RETRIEVE_SHUFFLED,
    "exact_name_bonus": EXACT,
    "retrieve_for_concepts": CONCEPTS,
    "dedup_queries": DEDUPLICATED,
    "hydrate_hits": HYDRATED,
}
