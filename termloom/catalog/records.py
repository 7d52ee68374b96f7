"""Queries over sources, canonical records, sampling and term tables."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.catalog.common import scratch, sql_strip, table
from termloom.functions import fixed_values as V
from termloom.functions.render import scalar_text
from termloom.functions.text import blank_to_null, compact_id
from termloom.operators import canonical as C
from termloom.operators import ontology as O
from termloom.operators import sampling as S
from termloom.plans.staging import spread
from termloom.sources.readers import read_jsonl_records, read_parquet_records, read_triples, read_tsv_records
from termloom.sources.writers import write_accessions, write_jsonl
from termloom.sources.xml import read_xml_records

SEED = 12345


# ---------------------------------------------------------------- sources and sinks


def read_parquet(spark: SparkSession, d: str) -> DataFrame:
    # Lines of an order stay together, so that their equal values are counted where they are.
    records = C.canonicalise(spread(read_parquet_records(spark, f"{d}/lineitem.parquet"), "l_orderkey"))
    return C.metadata_entries(records).groupBy("key").agg(
        F.count("*").alias("entries"), F.count_distinct("value").alias("distinct_values")
    )


READ_PARQUET = """
WITH e AS (
  SELECT unnest([
    {'key': 'l_orderkey', 'value': l_orderkey::VARCHAR}, {'key': 'l_partkey', 'value': l_partkey::VARCHAR},
    {'key': 'l_suppkey', 'value': l_suppkey::VARCHAR}, {'key': 'l_linenumber', 'value': l_linenumber::VARCHAR},
    {'key': 'l_quantity', 'value': l_quantity::VARCHAR}, {'key': 'l_extendedprice', 'value': l_extendedprice::VARCHAR},
    {'key': 'l_discount', 'value': l_discount::VARCHAR}, {'key': 'l_tax', 'value': l_tax::VARCHAR},
    {'key': 'l_returnflag', 'value': l_returnflag}, {'key': 'l_linestatus', 'value': l_linestatus},
    {'key': 'l_shipdate', 'value': l_shipdate::VARCHAR}]) AS x FROM lineitem)
SELECT x.key AS key, count(*) AS entries, count(DISTINCT x.value) AS distinct_values FROM e GROUP BY 1
"""


def read_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "tsv")
    rows = table(spark, d, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_mktsegment")).alias("segment")
    )
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return read_tsv_records(spark, path, ["segment", "c_custkey"])


READ_TSV = """
SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS segment, c_custkey::VARCHAR AS c_custkey
FROM customer
"""


def read_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    write_jsonl(table(spark, d, "documents").select("doc_id", "lang", "text"), path)
    back = read_jsonl_records(spark, path, "doc_id long, lang string, text string")
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"))


READ_JSONL = "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents"


def _nation_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples of the nations and regions: classes, labels, parents, synonyms, definitions."""
    o = V.OBO_PREFIX
    nation = table(spark, d, "nation").select(
        F.format_string(f"{o}NAT_%04d", "n_nationkey").alias("s"),
        F.col("n_name").alias("name"),
        F.format_string(f"{o}REG_%04d", "n_regionkey").alias("parent"),
        F.format_string("member %d of region %d", "n_nationkey", "n_regionkey").alias("text"),
    )
    region = table(spark, d, "region").select(
        F.format_string(f"{o}REG_%04d", "r_regionkey").alias("s"),
        F.col("r_name").alias("name"),
        F.lit("_:b0").alias("parent"),
        F.lit(" ").alias("text"),
    )
    exact = V.SYNONYM_PREDICATES[1]
    def uri(p: str, value: Column) -> Column:
        return F.struct(F.lit(p).alias("p"), value.alias("o"), F.lit(True).alias("o_is_uri"))
    def text(p: str, value: Column) -> Column:
        return F.struct(F.lit(p).alias("p"), value.alias("o"), F.lit(False).alias("o_is_uri"))
    facts = F.array(
        uri(V.RDF_TYPE, F.lit(V.OWL_CLASS)),
        text(V.RDFS_LABEL, F.col("name")),
        text(V.SYNONYM_PREDICATES[0], F.lower("name")),
        text(exact, F.replace(F.col("name"), F.lit("_"), F.lit(" "))),
        text(exact, F.col("name")),
        text(V.DEFINITION, F.col("text")),
        uri(V.RDFS_SUBCLASS_OF, F.col("parent")),
    )
    return nation.union(region).select("s", F.inline(facts)).withColumn("lang", F.lit(None).cast("string"))


def triples_from_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "triples")
    quoted = F.concat(F.lit('"'), F.col("o"), F.lit('"'))
    target = F.when(F.startswith("o", F.lit("_:")), F.col("o")).when(
        F.col("o_is_uri"), F.concat(F.lit("<"), F.col("o"), F.lit(">"))
    ).otherwise(quoted)
    _nation_triples(spark, d).select(
        F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), target, F.lit(" ."))
    ).write.text(path)
    return read_triples(spark, path)


def triple_counts(spark: SparkSession, d: str) -> DataFrame:
    return triples_from_file(spark, d).groupBy("p", "o_is_uri").agg(
        F.count("*").alias("triples"), F.count_distinct("o").alias("objects")
    )


_FACTS_SQL = f"""
names AS (
  SELECT printf('{V.OBO_PREFIX}NAT_%04d', n_nationkey) AS s, n_name AS name,
         printf('{V.OBO_PREFIX}REG_%04d', n_regionkey) AS parent,
         printf('member %d of region %d', n_nationkey, n_regionkey) AS text FROM nation
  UNION ALL
  SELECT printf('{V.OBO_PREFIX}REG_%04d', r_regionkey), r_name, '_:b0', ' ' FROM region),
facts AS (
  SELECT s, unnest([
    {{'p': '{V.RDF_TYPE}', 'o': '{V.OWL_CLASS}', 'u': true}}, {{'p': '{V.RDFS_LABEL}', 'o': name, 'u': false}},
    {{'p': '{V.SYNONYM_PREDICATES[0]}', 'o': lower(name), 'u': false}},
    {{'p': '{V.SYNONYM_PREDICATES[1]}', 'o': replace(name, '_', ' '), 'u': false}},
    {{'p': '{V.SYNONYM_PREDICATES[1]}', 'o': name, 'u': false}},
    {{'p': '{V.DEFINITION}', 'o': text, 'u': false}},
    {{'p': '{V.RDFS_SUBCLASS_OF}', 'o': parent, 'u': true}}]) AS f FROM names)
"""
TRIPLES = f"""
WITH {_FACTS_SQL}
SELECT f.p AS p, f.u AS o_is_uri, count(*) AS triples, count(DISTINCT f.o) AS objects FROM facts GROUP BY 1, 2
"""


def accessions_written(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "accessions")
    records = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("ORD"), F.col("o_orderkey"))).alias("accession"), "o_orderkey"
    )
    write_accessions(records, path, "o_orderkey")
    return spark.read.text(path).groupBy(F.col("value").alias("accession")).agg(F.count("*").alias("lines"))


ACCESSIONS = """
SELECT CASE WHEN o_orderstatus <> 'P' THEN 'ORD' || o_orderkey ELSE '' END AS accession, count(*) AS lines
FROM orders GROUP BY 1
"""


def xml_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as XML sample records, read back as canonical records."""
    path = scratch(spark, "xml")
    c = table(spark, d, "customer")
    def element(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    c.select(
        element(
            '<Sample accession="CUS', F.col("c_custkey"), '" id="', F.col("c_custkey"), '"><Description><Title> ',
            F.col("c_name"), " </Title></Description><Attributes>"
            '<Attribute attribute_name="Segment" harmonized_name="segment">', F.col("c_mktsegment"),
            '</Attribute><Attribute attribute_name="nation">', F.col("c_nationkey"),
            '</Attribute><Attribute attribute_name="nation">7</Attribute>'
            '<Attribute attribute_name="blank"> </Attribute></Attributes>'
            '<Ids><Id db="Shop" is_primary="1">', F.col("c_custkey"), "</Id></Ids></Sample>",
        )
    ).write.text(path)
    records = read_xml_records(spark, path, "Sample")
    return C.metadata_entries(records, "accession")


XML = """
SELECT 'CUS' || c_custkey AS accession, x.key AS key, x.value AS value FROM customer, unnest([
  {'key': 'accession', 'value': 'CUS' || c_custkey}, {'key': 'biosample_id', 'value': c_custkey::VARCHAR},
  {'key': 'title', 'value': c_name}, {'key': 'segment', 'value': c_mktsegment},
  {'key': 'original_attributes.Segment', 'value': c_mktsegment},
  {'key': 'nation', 'value': CASE WHEN c_nationkey = 7 THEN '7' ELSE c_nationkey || ' | 7' END},
  {'key': 'original_attributes.nation', 'value': CASE WHEN c_nationkey = 7 THEN '7' ELSE c_nationkey || ' | 7' END},
  {'key': 'id.Shop', 'value': c_custkey::VARCHAR}, {'key': 'id.Shop.is_primary', 'value': '1'}]) AS u(x)
"""


# ---------------------------------------------------------------- canonical records


def nonempty_text(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "[.]")).alias("part"))
    return lines.groupBy("doc_id").agg(
        F.count(blank_to_null(F.col("part"))).alias("filled"),
        F.sum(F.length(blank_to_null(F.col("part")))).alias("characters"),
    )


NONEMPTY = f"""
SELECT doc_id, count(nullif({sql_strip('part')}, '')) AS filled,
       sum(length(nullif({sql_strip('part')}, '')))::BIGINT AS characters
FROM (SELECT doc_id, unnest(string_split(text, '.')) AS part FROM documents) GROUP BY doc_id
"""


def scalar_rendering(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    types = {f.name: f.dataType for f in e.schema}
    return e.select(
        "event_id",
        scalar_text(F.col("ts"), types["ts"]).alias("ts_text"),
        scalar_text(F.col("value"), types["value"]).alias("value_text"),
        F.initcap((F.col("value") > 10).cast("string")).alias("flag_text"),
    )


RENDERING = """
SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts_text,
       value::VARCHAR AS value_text, CASE WHEN value > 10 THEN 'True' ELSE 'False' END AS flag_text
FROM events
"""


def _nested_events(spark: SparkSession, d: str) -> DataFrame:
    # One row group is one task, and a row is flattened and merged at a cost far above its size.
    return spread(table(spark, d, "events"), "event_id").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit(" EV"), F.col("event_id")).alias("accession"),
        F.create_map(F.lit("accession"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")).alias("attributes"),
        F.create_map(F.lit("Kind"), F.col("event_type")).alias("original_attributes"),
        F.struct(F.col("user_id").alias("user"), F.struct(F.col("value").alias("amount")).alias("deep")).alias("who"),
        F.array("event_type", F.lit(""), F.lit(None), F.lit("click"), "event_type").alias("kinds"),
        F.lit(float("nan")).alias("nothing"),
        (F.col("value") > 10).alias("flag"),
    )


def flattened(spark: SparkSession, d: str) -> DataFrame:
    records = C.canonicalise(_nested_events(spark, d), keep=["id"])
    return C.metadata_entries(records, "id")


_NESTED_SQL = """
SELECT event_id AS id, x.key AS key, x.value AS value FROM events, unnest([
  {'key': 'accession', 'value': 'EV' || event_id || ' | ' || event_type},
  {'key': 'k', 'value': json_extract_string(props, '$.k')},
  {'key': 'original_attributes.Kind', 'value': event_type}, {'key': 'who.user', 'value': user_id::VARCHAR},
  {'key': 'who.deep.amount', 'value': value::VARCHAR},
  {'key': 'kinds', 'value': CASE WHEN event_type = 'click' THEN 'click' ELSE event_type || ' | click' END},
  {'key': 'flag', 'value': CASE WHEN value > 10 THEN 'True' ELSE 'False' END}]) AS u(x)
"""


def sorted_metadata(spark: SparkSession, d: str) -> DataFrame:
    records = C.canonicalise(_nested_events(spark, d), keep=["id"])
    return records.select("id", "accession", F.array_join(F.map_keys("metadata"), ",").alias("keys"))


SORTED = """
SELECT event_id AS id, 'EV' || event_id AS accession,
       'accession,flag,k,kinds,original_attributes.Kind,who.deep.amount,who.user' AS keys FROM events
"""


def canonical_orders(spark: SparkSession, d: str) -> DataFrame:
    records = C.canonicalise(table(spark, d, "orders"), keep=["o_orderkey"], columns=table(spark, d, "orders").columns)
    return C.metadata_entries(records, "o_orderkey")


CANONICAL_ORDERS = """
SELECT o_orderkey, x.key AS key, x.value AS value FROM orders, unnest([
  {'key': 'o_orderkey', 'value': o_orderkey::VARCHAR}, {'key': 'o_custkey', 'value': o_custkey::VARCHAR},
  {'key': 'o_orderstatus', 'value': o_orderstatus}, {'key': 'o_totalprice', 'value': o_totalprice::VARCHAR},
  {'key': 'o_orderdate', 'value': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')},
  {'key': 'o_orderpriority', 'value': o_orderpriority}]) AS u(x)
"""


def canonical_customers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    records = C.canonicalise(c, keep=["c_custkey"], columns=c.columns)
    return C.metadata_entries(records, "c_custkey")


CANONICAL_CUSTOMERS = """
SELECT c_custkey, x.key AS key, x.value AS value FROM customer, unnest([
  {'key': 'c_custkey', 'value': c_custkey::VARCHAR}, {'key': 'c_name', 'value': c_name},
  {'key': 'c_nationkey', 'value': c_nationkey::VARCHAR}, {'key': 'c_acctbal', 'value': c_acctbal::VARCHAR},
  {'key': 'c_mktsegment', 'value': c_mktsegment}]) AS u(x)
"""


def merge_repeated(spark: SparkSession, d: str) -> DataFrame:
    values = F.filter(F.transform(F.split("text", "\n"), blank_to_null), lambda v: v.isNotNull())
    merged = table(spark, d, "documents").select("doc_id", C.merge_values(values).alias("merged"))
    return merged.select("doc_id", F.length("merged").alias("characters"), F.md5("merged").alias("merged_md5"))


MERGE = f"""
WITH v AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: nullif({sql_strip('x')}, '')),
                             lambda x: x IS NOT NULL) AS vals FROM documents),
m AS (SELECT doc_id, list_reduce(vals, lambda a, x: CASE WHEN list_contains(string_split(a, ' | '), x) THEN a
                                                    ELSE a || ' | ' || x END) AS merged FROM v)
SELECT doc_id, length(merged) AS characters, md5(merged) AS merged_md5 FROM m
"""


def accession_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_acctbal") > 5000, F.concat(F.lit(" S"), F.col("s_suppkey"))).otherwise(" ").alias("accession"),
        F.when(F.col("s_acctbal") > 0, F.create_map(F.lit("id.BioSample"), F.col("s_name"))).alias("identifiers"),
    )
    return C.canonicalise(rows, keep=["s_suppkey"]).select("s_suppkey", "accession")


ACCESSION_CHOICE = """
SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'S' || s_suppkey WHEN s_acctbal > 0 THEN s_name END AS accession
FROM supplier
"""


def _sparse_customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("c_name"),
        F.when(F.col("c_nationkey") > 12, F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )


def enough_fields(spark: SparkSession, d: str) -> DataFrame:
    records = C.canonicalise(_sparse_customers(spark, d), keep=["c_custkey"], columns=["c_custkey", "c_name", "c_mktsegment"])
    return C.at_least_fields(records, 2).select("c_custkey", C.count_nonempty().alias("fields"))


ENOUGH = """
SELECT * FROM (SELECT c_custkey, 1 + (c_acctbal > 0)::INT + (c_nationkey <= 12)::INT AS fields FROM customer) WHERE fields >= 2
"""


def missing_accessions(spark: SparkSession, d: str) -> DataFrame:
    rows = _sparse_customers(spark, d).withColumnRenamed("c_name", "accession")
    return C.missing_accession_count(C.canonicalise(rows, keep=["c_custkey"]))


MISSING = "SELECT count(*) FILTER (c_acctbal <= 0) AS missing_accessions FROM customer"


def selected_fields(spark: SparkSession, d: str) -> DataFrame:
    return C.select_fields(table(spark, d, "part"), ["p_type", "p_partkey", "p_name"])


def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit(" "), F.col("c_name"), F.lit("\t")).alias("name"),
        F.when(F.col("c_nationkey") > 12, "n/a").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
    )
    records = C.fields_to_metadata(rows, ["segment", "name", "balance"], keep=["c_custkey"])
    return records.select("c_custkey", C.record_to_text().alias("record_text"))


PROMPT_TEXT = """
SELECT c_custkey, concat_ws(chr(10), CASE WHEN c_nationkey <= 12 THEN 'segment=' || c_mktsegment END, 'name=' || c_name,
       CASE WHEN c_acctbal >= 0 THEN 'balance=' || c_acctbal::VARCHAR END) AS record_text FROM customer
"""


# ---------------------------------------------------------------- sampling


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.hash_sample(table(spark, d, "orders"), 200, SEED, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


HASH_SAMPLE = f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey LIMIT 200
"""


def large_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    key = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]
    sampled = S.hash_sample(table(spark, d, "lineitem"), 5000, SEED, key)
    return sampled.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


LARGE_HASH_SAMPLE = f"""
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY md5('{SEED}:' || l_orderkey || ':' || l_partkey || ':' || l_linenumber || ':' || l_extendedprice::VARCHAR),
         l_orderkey, l_partkey, l_linenumber, l_extendedprice LIMIT 5000
"""


def sampled_records(spark: SparkSession, d: str) -> DataFrame:
    rows = _sparse_customers(spark, d)
    sampled = S.sample_records(rows, 100, SEED, ["c_custkey"], min_nonempty_fields=2)
    return C.metadata_entries(sampled, "c_custkey")


SAMPLED_RECORDS = f"""
WITH s AS (
  SELECT * FROM customer WHERE 1 + (c_acctbal > 0)::INT + (c_nationkey <= 12)::INT >= 2
  ORDER BY md5('{SEED}:' || c_custkey), c_custkey LIMIT 100)
SELECT c_custkey, x.key AS key, x.value AS value FROM s, unnest([
  {{'key': 'c_custkey', 'value': c_custkey::VARCHAR}},
  {{'key': 'c_name', 'value': CASE WHEN c_acctbal > 0 THEN c_name END}},
  {{'key': 'c_mktsegment', 'value': CASE WHEN c_nationkey <= 12 THEN c_mktsegment END}}]) AS u(x)
WHERE x.value IS NOT NULL
"""


def sample_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = _sparse_customers(spark, d)
    population = C.canonicalise(rows, keep=["c_custkey"], columns=rows.columns)
    return S.sample_provenance(population, 100, SEED, "parquet", min_nonempty_fields=2)


PROVENANCE = f"""
SELECT 'smallest_hash' AS method, count(*) AS population_records, count(*) FILTER (f >= 2) AS eligible_records,
       least(100, count(*) FILTER (f >= 2)) AS sampled_records, 'parquet' AS input_format, 100 AS requested_records,
       {SEED} AS seed, 2 AS min_nonempty_fields
FROM (SELECT 1 + (c_acctbal > 0)::INT + (c_nationkey <= 12)::INT AS f FROM customer)
"""


def source_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.source_sample(spark, f"{d}/orders.parquet", 200, SEED, ["o_orderkey"]).select("pos", "o_orderkey")


SOURCE_SAMPLE = f"""
SELECT pos, o_orderkey FROM (SELECT row_number() OVER () - 1 AS pos, o_orderkey FROM orders)
ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey LIMIT 200
"""


def source_sample_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Provenance of ``source_sample``: its positions as text, so that every engine compares them alike."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    population = C.canonicalise(rows, keep=["o_orderkey"], columns=rows.columns)
    found = S.sample_provenance(population, 200, SEED, "parquet", positions=source_sample(spark, d).select("pos"))
    return found.withColumn("source_row_indices", F.concat_ws(",", F.col("source_row_indices").cast("array<string>")))


SOURCE_SAMPLE_PROVENANCE = f"""
SELECT 'smallest_hash' AS method, count(*) AS population_records, count(*) AS eligible_records,
       least(200, count(*)) AS sampled_records, 'parquet' AS input_format, 200 AS requested_records, {SEED} AS seed,
       0 AS min_nonempty_fields, (SELECT string_agg(pos::VARCHAR, ',' ORDER BY pos) FROM ({SOURCE_SAMPLE})) AS source_row_indices
FROM orders
"""


def source_position(spark: SparkSession, d: str) -> DataFrame:
    return S.source_position(spark, f"{d}/orders.parquet").select("pos", "o_orderkey")


SOURCE_POSITION = "SELECT row_number() OVER () - 1 AS pos, o_orderkey FROM orders"


def position_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.position_sample(spark, f"{d}/lineitem.parquet", 200, SEED).select("pos", "l_orderkey", "l_linenumber")


def _position_sample_sql() -> str | None:
    """The seeded draws for the row counts of the test folders, joined by row count."""
    draws = []
    for folder in ("sf0.001", "sf0.01", "sf0.1"):
        file = Path("/root/testdata", folder, "lineitem.parquet")
        if file.is_file():
            total = pq.ParquetFile(file).metadata.num_rows
            draws += [f"({total}, {pos})" for pos in random.Random(SEED).sample(range(total), min(200, total))]
    if not draws:
        return None
    return f"""
WITH draws(total, pos) AS (VALUES {", ".join(draws)}),
numbered AS (SELECT row_number() OVER () - 1 AS pos, l_orderkey, l_linenumber FROM lineitem)
SELECT pos, l_orderkey, l_linenumber FROM numbered JOIN draws USING (pos)
WHERE total = (SELECT count(*) FROM lineitem)
"""


# ---------------------------------------------------------------- term tables


def labelled_subjects(spark: SparkSession, d: str) -> DataFrame:
    return O.labelled_subjects(_nation_triples(spark, d))


LABELLED = f"WITH {_FACTS_SQL} SELECT DISTINCT s AS iri FROM names"


def term_table(spark: SparkSession, d: str) -> DataFrame:
    terms = O.number_terms(O.terms_from_triples(triples_from_file(spark, d)))
    return terms.select(
        "term_no", "id", "iri", "label", F.array_join("synonyms", " ; ").alias("synonyms"), "definition",
        F.array_join("parents", ",").alias("parents"),
    )


TERM_TABLE = f"""
WITH {_FACTS_SQL}
SELECT row_number() OVER (ORDER BY s) - 1 AS term_no, replace(replace(s, '{V.OBO_PREFIX}', ''), '_', ':') AS id, s AS iri,
       name AS label, CASE WHEN contains(name, '_') THEN lower(name) || ' ; ' || replace(name, '_', ' ') ELSE lower(name) END AS synonyms,
       trim(text) AS definition,
       CASE WHEN parent LIKE '\\_:%' ESCAPE '\\' THEN '' ELSE replace(replace(parent, '{V.OBO_PREFIX}', ''), '_', ':') END AS parents
FROM names
"""


def compact_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_nationkey") < 5, F.lit("https://example.org/a_b"))
        .otherwise(F.concat(F.lit(V.OBO_PREFIX + "SUP_"), F.col("s_suppkey"), F.lit("_x"))).alias("uri"),
    )
    return rows.select("s_suppkey", compact_id(F.col("uri")).alias("id"))


COMPACT = """
SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'https://example.org/a_b' ELSE 'SUP:' || s_suppkey || '_x' END AS id
FROM supplier
"""

QUERIES = {
    "read_parquet_records": read_parquet,
    "read_tsv_records": read_tsv,
    "read_jsonl_records": read_jsonl,
    "read_triples": triple_counts,
    "read_xml_records": xml_records,
    "write_accessions": accessions_written,
    "nonempty_text": nonempty_text,
    "scalar_rendering": scalar_rendering,
    "flatten_columns": flattened,
    "sort_metadata": sorted_metadata,
    "canonicalise_orders": canonical_orders,
    "canonicalise_customers": canonical_customers,
    "merge_repeated": merge_repeated,
    "resolve_accession": accession_choice,
    "min_nonempty_fields": enough_fields,
    "missing_accession_count": missing_accessions,
    "select_fields": selected_fields,
    "record_to_text": prompt_text,
    "hash_sample": hash_sample,
    "hash_sample_by_ranges": large_hash_sample,
    "sample_records": sampled_records,
    "sample_provenance": sample_provenance,
    "source_sample": source_sample,
    "source_sample_provenance": source_sample_provenance,
    "source_position": source_position,
    "position_sample": position_sample,
    "labelled_subjects": labelled_subjects,
    "terms_from_triples": term_table,
    "compact_id": compact_ids,
}
ORACLES = {
    "read_parquet_records": READ_PARQUET,
    "read_tsv_records": READ_TSV,
    "read_jsonl_records": READ_JSONL,
    "read_triples": TRIPLES,
    "read_xml_records": XML,
    "write_accessions": ACCESSIONS,
    "nonempty_text": NONEMPTY,
    "scalar_rendering": RENDERING,
    "flatten_columns": _NESTED_SQL,
    "sort_metadata": SORTED,
    "canonicalise_orders": CANONICAL_ORDERS,
    "canonicalise_customers": CANONICAL_CUSTOMERS,
    "merge_repeated": MERGE,
    "resolve_accession": ACCESSION_CHOICE,
    "min_nonempty_fields": ENOUGH,
    "missing_accession_count": MISSING,
    "select_fields": "SELECT p_type, p_partkey, p_name FROM part",
    "record_to_text": PROMPT_TEXT,
    "hash_sample": HASH_SAMPLE,
    "hash_sample_by_ranges": LARGE_HASH_SAMPLE,
    "sample_records": SAMPLED_RECORDS,
    "sample_provenance": PROVENANCE,
    "source_sample": SOURCE_SAMPLE,
    "source_sample_provenance": SOURCE_SAMPLE_PROVENANCE,
    "source_position": SOURCE_POSITION,
    "labelled_subjects": LABELLED,
    "terms_from_triples": TERM_TABLE,
    "compact_id": COMPACT,
}
if sql := _position_sample_sql():
    ORACLES["position_sample"] = sql
