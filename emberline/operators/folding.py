"""Claims of one meaning fold into one; figures of a graph; windows that close."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("subject_id", "claim_type", "object_id")
#: The types of which a subject has one current claim.
EXCLUSIVE = ("WORKS_AT", "REPORTS_TO")


def fold(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical claims, merge events) of claims (claim_id, KEY, properties, confidence, valid_from, valid_to, evidence_ids, seq).

    Per subject, type and object the most confident claim stays, of equal ones the first by ``seq``, with its properties; the
    window widens to the earliest start and the latest end that is known, and evidence is put together in order.
    """
    place = F.struct(-F.col("confidence"), F.col("seq"))
    some = claims.withColumn("_at", place)
    kept = some.groupBy(*KEY).agg(
        F.min_by(F.struct("claim_id", "properties"), "_at").alias("_own"),
        F.max("confidence").alias("confidence"),
        F.min("valid_from").alias("valid_from"),
        F.max("valid_to").alias("valid_to"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "evidence_ids"))), lambda x: x["evidence_ids"])).alias("evidence_ids"),
    )
    canonical = kept.select(F.col("_own.claim_id").alias("claim_id"), *KEY, F.col("_own.properties").alias("properties"), "confidence", "valid_from", "valid_to", "evidence_ids")
    # the events without the lists: one shuffle of the claims, in which each meets the first of its key
    first = F.first("claim_id").over(Window.partitionBy(*KEY).orderBy("_at"))
    events = some.select(*KEY, F.col("claim_id").alias("merged_from"), first.alias("merged_into")).filter(" AND ".join(f"{k} IS NOT NULL" for k in KEY) + " AND merged_from != merged_into")
    reason = F.concat(F.lit("same_semantic_key:('"), F.concat_ws("', '", *KEY), F.lit("')"))
    return canonical, events.select("merged_from", "merged_into", reason.alias("reason"))


def superseded(claims: DataFrame, events: DataFrame, at) -> DataFrame:
    """``claims`` where those merged away are no longer current and end at ``at``."""
    gone = events.select(F.col("merged_from").alias("claim_id")).distinct().withColumn("_gone", F.lit(True))
    rows = claims.join(gone, "claim_id", "left")
    return rows.select(*[F.when(F.col("_gone"), v).otherwise(F.col(c)).alias(c) if (v := {"is_current": F.lit(False), "valid_to": F.lit(at)}.get(c)) is not None else F.col(c) for c in claims.columns])


def metrics(emails: DataFrame, entities: DataFrame, claims: DataFrame, evidence: DataFrame, merges: DataFrame, log: DataFrame) -> DataFrame:
    """One row of fourteen figures. One pass a table; the rows that are joined are single."""
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    of_claims = claims.agg(
        F.count(F.lit(1)).alias("total_claims"), F.count_if("pending_review").alias("pending_review_claims"), F.count_if("is_current").alias("current_claims"), F.count_if(~F.col("is_current")).alias("historical_claims"),
        F.count_if(F.col("confidence") < 0.5).alias("low_confidence_claims"), F.count_if(F.col("confidence") >= 0.8).alias("high_confidence_claims"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
    )
    of_merges = merges.agg(F.count(F.lit(1)).alias("total_merges"), F.count("reversed_at").alias("reversed_merges"))
    of_log = log.agg(F.count_if(F.col("status") == "failed").alias("failed_extractions"), F.count_if(F.col("status") == "completed").alias("completed_extractions"))
    out = total(emails, "total_emails")
    for one in (total(entities, "total_entities"), of_claims, total(evidence, "total_evidence"), of_merges, of_log):
        out = out.join(F.broadcast(one))
    return out


def export_stats(entities: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: counts of nodes, edges (all, current, historical, pending), evidence, by entity type and claim type, mean confidence."""
    one = lambda df, c, name: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(name))
    edges = claims.agg(
        F.count(F.lit(1)).alias("edge_count"), F.count_if("is_current").alias("current_edge_count"), F.count_if(~F.col("is_current")).alias("historical_edge_count"),
        F.count_if("pending_review").alias("pending_review_count"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"),
    )
    out = entities.agg(F.count(F.lit(1)).alias("node_count")).join(F.broadcast(edges))
    snippets = evidence.join(claims.select("claim_id"), "claim_id", "left_semi").agg(F.count(F.lit(1)).alias("total_evidence_snippets"))
    for more in (one(entities, "entity_type", "entity_type_counts"), one(claims, "claim_type", "claim_type_counts"), snippets):
        out = out.join(F.broadcast(more))
    return out


def started(claims: DataFrame, types: tuple[str, ...] = EXCLUSIVE) -> DataFrame:
    """Current claims of exclusive types; one without a start starts when it was seen, if ``seen_at`` is there."""
    some = claims.filter(F.col("claim_type").isin(*types) & F.col("is_current"))
    return some.withColumn("valid_from", F.coalesce("valid_from", "seen_at")) if "seen_at" in claims.columns else some


def closed_windows(claims: DataFrame, types: tuple[str, ...] = EXCLUSIVE) -> DataFrame:
    """Current claims of exclusive types that end where the subject's next one starts, or at their own end before; only the last stays current.

    A claim that is there twice with one start counts once. ``streaming.windows`` keeps the same table up to date.
    """
    rows = started(claims, types).dropDuplicates(["subject_id", "claim_type", "claim_id", "valid_from"])
    after = Window.partitionBy("subject_id", "claim_type").orderBy("valid_from", "claim_id")
    rows = rows.withColumn("_next", F.lead("valid_from").over(after)).withColumn("_last", F.lead("claim_id").over(after).isNull())
    return rows.withColumn("valid_to", F.least("valid_to", "_next")).withColumn("is_current", F.col("_last")).drop("_next", "_last")
