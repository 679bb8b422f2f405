"""Registered queries of lookups, texts and statistics, and SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import extraction, graph, lookup, neardup, resolution
from emberline.plans.graph_queries import _tidy, role, with_roles
from emberline.session import table


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with properties that a text tells and others; organisations have no alias."""
    rows = role(spark, sf_dir, "entities")
    person = F.col("entity_type") == "Person"
    told = F.when(person, F.create_map(F.lit("kind"), F.lit("x"), F.lit("title"), F.concat(F.lit("no. "), F.col("id")), F.lit("role"), F.lit("customer"))).otherwise(F.create_map(F.lit("description"), F.lower("entity_type")))
    none = F.array().cast("array<string>")
    return rows.withColumn("properties", told).withColumn("aliases", F.when(F.col("entity_type") == "Organization", none).otherwise(F.array_append("aliases", F.upper("id"))))


def names_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the names of every hundredth customer, as persons and as topics; aliases of every hundredth supplier; names of
    every hundredth part, of which several may be one, in their own case and in capitals, which nothing is written in."""
    entities = role(spark, sf_dir, "entities")
    key = F.substring_index("id", ":", -1).cast("long")
    some = entities.filter((key % 100 == 0) & F.substring("id", 1, 1).isin("c", "s", "p"))
    kind, typed = F.substring("id", 1, 1), lambda t: F.lit(t).cast("string")
    ask = lambda rows, name, t: rows.select(name.alias("name"), typed(t).alias("entity_type"))
    people, parts = some.filter(kind == "c"), some.filter(kind == "p")
    asked = ask(people, F.col("canonical_name"), "Person").unionByName(ask(people, F.col("canonical_name"), "Topic")).unionByName(ask(some.filter(kind == "s"), F.concat(F.lit("alias "), "id"), None))
    asked = asked.unionByName(ask(parts, F.col("canonical_name"), None)).unionByName(ask(parts, F.upper("canonical_name"), None))
    return lookup.by_name(entities, asked).select("name", "id", "canonical_name", "entity_type")


def rows_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the entities and the claims whose ids belong to every hundredth key; some ids are asked for twice, some do not exist."""
    customers = table(spark, sf_dir, "customer").filter("c_custkey % 100 = 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"))
    entities = lookup.by_id(role(spark, sf_dir, "entities"), customers.unionByName(customers).unionByName(customers.select(F.concat("id", F.lit("x")).alias("id"))))
    claims = role(spark, sf_dir, "claims")
    found = lookup.by_id(claims, claims.filter("source_id % 100 = 0"), "claim_id")
    return entities.select(F.lit("entity").alias("kind"), "id", F.col("canonical_name").alias("what")).unionByName(found.select(F.lit("claim").alias("kind"), F.col("claim_id").alias("id"), F.col("claim_type").alias("what")))


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """persons and organisations with "S:1" in a name or alias, whatever the case."""
    return lookup.search(role(spark, sf_dir, "entities"), "S:1", ["Person", "Organization"]).select("id", "canonical_name")


def entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _described(spark, sf_dir)
    return rows.select("id", lookup.entity_text(rows).alias("text"))


def claim_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.with_names(role(spark, sf_dir, "claims"), graph.hashed(role(spark, sf_dir, "entities")), "left")
    rows = rows.withColumn("properties", F.create_map(F.lit("source"), F.col("source_id").cast("string"), F.lit("until"), F.date_format("valid_to", "yyyy-MM-dd")))
    return rows.select("claim_id", lookup.claim_text(rows).alias("text"))


def dedup_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mails: exact by source and text, then near copies; of each group the first doc_id stays."""
    docs = table(spark, sf_dir, "documents")
    key = F.sha2(F.concat_ws("|", F.coalesce("source", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)), 256)
    return neardup.dedup_outcome(docs.select("doc_id", "source", "text"), key)


def extraction_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as a mail, read by the offline rules; what came of it."""
    none = F.lit(None).cast("string")
    mails = table(spark, sf_dir, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("message_id"), F.col("role").alias("sender"), F.lit(None).cast("array<string>").alias("recipients"),
        none.alias("date"), none.alias("subject"), F.col("text").alias("body"),
    )
    mails = mails.filter("message_id IS NOT NULL").groupBy("message_id").agg(*[F.min(c).alias(c) for c in mails.columns[1:]])
    return extraction.extraction_stats(extraction.extract(mails, per_minute=None))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, a, b, sim. 'pair': different names of parts, each by the first part that has it, that are alike when read as
    first and last name. 'member': every part b and the first part a of its name."""
    parts = role(spark, sf_dir, "entities").filter("entity_type = 'Document'")
    first = parts.groupBy("canonical_name", "entity_type").agg(F.min("id").alias("id"))
    pairs = resolution.similar_pairs(first.withColumn("aliases", F.array().cast("array<string>"))).select(F.lit("pair").alias("kind"), "a", "b", F.round("sim", 6).alias("sim"))
    return pairs.unionByName(parts.join(first.select("canonical_name", F.col("id").alias("a")), "canonical_name").select(F.lit("member").alias("kind"), "a", F.col("id").alias("b"), F.lit(1.0).alias("sim")))


QUERIES = {
    "f3_names_and_aliases": names_found, "f4_by_id": rows_found, "f13_search_aliases": searched, "t18_entity_texts": entity_texts, "t19_claim_texts": claim_texts,
    "a8_dedup_outcome": dedup_outcome, "a14_extraction_outcome": extraction_outcome, "j12_name_pairs": name_pairs,
}

#: ``a8_dedup_outcome``, ``a14_extraction_outcome`` and ``j12_name_pairs`` have none: near copies, validated answers and common
#: subsequences are too slow or no SQL; tests hold them against brute force.
SQL = {
    "f3_names_and_aliases": with_roles("entities", """, every AS (SELECT id, canonical_name, entity_type, canonical_name AS name FROM entities UNION SELECT id, canonical_name, entity_type, 'alias ' || id FROM entities),
asked AS (SELECT c_name AS name, 'Person' AS t FROM customer WHERE c_custkey % 100 = 0 UNION SELECT c_name, 'Topic' FROM customer WHERE c_custkey % 100 = 0
  UNION SELECT 'alias s:' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 100 = 0 UNION SELECT p_name, NULL FROM part WHERE p_partkey % 100 = 0 UNION SELECT upper(p_name), NULL FROM part WHERE p_partkey % 100 = 0)
SELECT DISTINCT e.name, id, canonical_name, entity_type FROM every e JOIN asked a ON a.name = e.name AND (a.t IS NULL OR a.t = e.entity_type)"""),
    "f4_by_id": with_roles("claims", """SELECT 'entity' AS kind, concat('c:', c_custkey) AS id, c_name AS what FROM customer WHERE c_custkey % 100 = 0
UNION ALL SELECT 'claim', claim_id, claim_type FROM claims WHERE source_id % 100 = 0"""),
    "f13_search_aliases": """SELECT concat('s:', s_suppkey) AS id, s_name AS canonical_name FROM supplier WHERE CAST(s_suppkey AS VARCHAR) LIKE '1%' OR s_name ILIKE '%s:1%'
UNION ALL SELECT concat('c:', c_custkey), c_name FROM customer WHERE c_name ILIKE '%s:1%'""",
    "t18_entity_texts": with_roles("entities", """SELECT id, canonical_name || ' (' || entity_type || ')' || CASE WHEN entity_type <> 'Organization' THEN ' also known as: alias ' || id || ', ' || upper(id) ELSE '' END
|| CASE WHEN entity_type = 'Person' THEN ' role: customer title: no. ' || id ELSE ' description: ' || lower(entity_type) END AS text FROM entities"""),
    "t19_claim_texts": with_roles("entities claims", """SELECT claim_id, coalesce(s.canonical_name, '') || ' ' || claim_type || ' ' || coalesce(o.canonical_name, '') || ' source: ' || source_id
|| CASE WHEN valid_to IS NULL THEN '' ELSE ' until: ' || strftime(valid_to, '%Y-%m-%d') END AS text FROM claims LEFT JOIN entities s ON s.id = subject_id LEFT JOIN entities o ON o.id = object_id"""),
}
SQL = {name: _tidy(text) for name, text in SQL.items()}
