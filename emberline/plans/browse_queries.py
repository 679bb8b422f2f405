"""The queries of ``graph_sql`` as calls of the operators; the SQL there is what they are held against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import browse, constraints, folding, graph, lookup, threads
from emberline.operators.folding import KEY
from emberline.plans.graph_queries import role
from emberline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _no_properties() -> Column:
    return F.create_map().cast("map<string,string>")


class _Tables:
    """The adapters and tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def role(self, name: str) -> DataFrame:
        return role(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def plain_entities(self) -> DataFrame:
        """Entities without aliases and properties."""
        return self.role("entities").withColumn("aliases", _no_names()).withColumn("properties", _no_properties())

    def frame(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)


def _query(of: Callable[[_Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: of(_Tables(spark, sf_dir))


def _violations(t: _Tables) -> DataFrame:
    types = "WORKS_AT REPORTS_TO MENTIONS PARTICIPATES_IN DISCUSSES SENT_TO".split()
    must = {"confidence": F.col("confidence").between(0, 1), "window": F.col("valid_to") >= F.col("valid_from"), "type": F.col("claim_type").isin(*types)}
    return constraints.split(constraints.broken(t.role("claims"), must))[1].select("claim_id")


def _queued(t: _Tables) -> DataFrame:
    """Documents by length; a label of good quality stands for a completed extraction."""
    emails = t.table("documents").select(F.col("doc_id").alias("message_id"), F.col("n_chars").alias("date"))
    log = t.table("labels").select(F.col("doc_id").alias("email_id"), F.lit("v1").alias("extraction_version"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    return browse.queued(emails, log, "v1", 200).select(F.col("message_id").alias("doc_id"))


def _sources(t: _Tables) -> DataFrame:
    """Claims as evidence and orders as messages."""
    orders = t.table("orders").select(F.col("o_orderkey").alias("message_id"), F.lit(None).cast("string").alias("sender"), F.col("o_orderpriority").alias("subject"), F.col("o_orderdate").cast("date").alias("date"))
    return browse.sourced(t.role("claims").select("claim_id", "source_id"), orders).select("claim_id", "source_id", "email_subject", "source_date")


def _visited(t: _Tables) -> DataFrame:
    met = t.role("claims").filter("subject_id = 'c:7'").select(F.col("object_id").alias("id"))
    return lookup.by_id(t.role("entities"), met).select("id", "canonical_name")


def _replies(t: _Tables) -> DataFrame:
    mails = t.role("messages").withColumn("references", _no_names())
    return threads.reply_edges(mails).select(F.col("u").alias("child"), F.col("v").alias("parent"))


def _threads(t: _Tables) -> DataFrame:
    """Conversations are threads, named by their smallest message."""
    messages = t.role("messages")
    names = messages.groupBy("conv_id").agg(F.min("message_id").alias("thread_id"))
    found = browse.rollup(messages, "conv_id", "turn").join(names, "conv_id")
    return found.select("conv_id", "thread_id", "size", "participants", F.col("first").alias("first_turn"), F.col("last").alias("last_turn"))


def _deduplicated(t: _Tables) -> DataFrame:
    total = browse.parse_stats(t.role("emails"), "sender", "body")
    return total.select(F.col("total").alias("input"), F.col("unique").alias("after_exact"), F.col("duplicates").alias("removed"))


def _parsed(t: _Tables) -> DataFrame:
    return browse.parse_stats(t.role("emails"), "body").select("total", F.col("unique").alias("bodies"), "senders")


def _canonical(t: _Tables) -> DataFrame:
    return browse.first_of(t.role("claims"), *KEY, order="claim_id", best=F.col("confidence")).select("claim_id")


def _closed(t: _Tables) -> DataFrame:
    return folding.closed_windows(t.role("claims")).select("claim_id", "valid_from", "valid_to", "is_current")


def _entity_text(t: _Tables) -> DataFrame:
    rows = t.plain_entities()
    return rows.select("id", lookup.entity_text(rows).alias("text"))


def _claim_text(t: _Tables) -> DataFrame:
    rows = graph.with_names(t.role("claims"), graph.hashed(t.role("entities"))).withColumn("properties", _no_properties())
    return rows.select("claim_id", lookup.claim_text(rows).alias("text"))


QUERIES: dict[str, Query] = {
    name: _query(of)
    for name, of in {
        "f3_exact_match": lambda t: lookup.by_name(t.role("entities"), t.frame("name string, entity_type string", ("Customer#000000007", "Person"))).select("id", "canonical_name", "entity_type"),
        "f4_entity_by_id": lambda t: lookup.by_id(t.role("entities"), t.frame("id string", ("s:3",))).select("id", "canonical_name", "entity_type"),
        "f5_list_entities": lambda t: browse.list_entities(t.role("entities"), "Person", 50, 20).select("id", "canonical_name"),
        "f7_confidence_gate": lambda t: browse.confident(t.role("claims"), 0.45).select("claim_id", "confidence"),
        "f8_review_queue": lambda t: browse.review_queue(t.role("claims"), 50).select("claim_id", "subject_id", "object_id", "confidence"),
        "f9_as_of": lambda t: browse.as_of(t.role("claims"), date(1996, 1, 1)).select("claim_id"),
        "f11_graph_edges": lambda t: browse.drawn_edges(t.role("claims")),
        "f13_entity_search": lambda t: lookup.search(t.plain_entities(), "00001").select("id", "canonical_name"),
        "f14_confidence_band": lambda t: t.role("claims").select("claim_id", browse.band(F.col("confidence")).alias("band")),
        "f18_check_violations": _violations,
        "j1_unprocessed": _queued,
        "j2_named_claims": lambda t: graph.with_names(t.role("claims"), graph.hashed(t.role("entities"))).select("claim_id", "subject_name", "claim_type", "object_name"),
        "j3_evidence_sources": _sources,
        "j5_visited_entities": _visited,
        "j6_top_entities": lambda t: browse.top_entities(t.role("entities"), t.role("claims"), 20).select("id", "canonical_name", "claim_count"),
        "j7_duplicate_claims": lambda t: browse.repeated(t.role("claims")).select("claim_id", *KEY),
        "j9_reply_edges": _replies,
        "j13_conflicts": lambda t: graph.conflicts(t.role("claims")).select("a_id", "b_id"),
        "u1_table_counts": lambda t: browse.table_counts({n: t.table(n) for n in ("documents", "orders", "lineitem")}),
        "a1_stats": lambda t: browse.stats({"emails": t.table("documents"), "entities": t.role("entities"), "claims": t.role("claims"), "evidence": t.table("lineitem")}),
        "a4_duplicate_groups": lambda t: browse.repeated_groups(t.role("claims")),
        "a6_thread_rollup": _threads,
        "a7_exact_dedup": lambda t: browse.exact_events(t.role("emails"), "sender", "body")[0].select("message_id"),
        "a8_dedup_stats": _deduplicated,
        "a9_thread_stats": lambda t: browse.thread_stats(t.role("messages"), "conv_id").select("threads", F.round("avg_size", 6).alias("avg_size"), "max_size"),
        "a10_parse_stats": _parsed,
        "a11_claim_type_counts": lambda t: browse.type_counts(t.role("claims")),
        "a14_log_stats": lambda t: browse.log_counts(t.table("events"), "event_type", "user_id", "users"),
        "a15_node_degree": lambda t: browse.drawn_sizes(t.role("claims")),
        "a16_entity_types": lambda t: browse.entity_types(t.role("entities")),
        "n2_canonical_claim": _canonical,
        "n4_window_closing": _closed,
        "t18_entity_text": _entity_text,
        "t19_claim_text": _claim_text,
    }.items()
}
