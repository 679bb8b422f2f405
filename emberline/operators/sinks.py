"""Tables of the graph as Parquet folders: appends, keyed writes, logs and exports that may be run again.

Tables are kept by ``store.Store``: a keyed write copies only the buckets that its keys fall into, and a job that dies
leaves the table as it was. Reading and writing are Spark's; nothing passes through the driver but names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import writes
from emberline.operators.store import Store

TABLES = ("evidence", "claims", "merge_events", "processing_log", "embeddings", "threads", "dedup_log", "entities", "emails")


def read(spark: SparkSession, base: str, name: str, like: DataFrame | None = None) -> DataFrame:
    """The table, or before its first write an empty one like ``like``."""
    return Store(spark, f"{base}/{name}").read(like)


def rewrite(base: str, name: str, table: DataFrame) -> None:
    """Put ``table`` in the place of the one that it may have been read from."""
    Store(table.sparkSession, f"{base}/{name}").replace(table)


def insert_ignore(base: str, name: str, rows: DataFrame, keys: list[str], order: str) -> None:
    """Keep what is there; add the rows whose keys are new. Running it again changes nothing."""
    Store(rows.sparkSession, f"{base}/{name}").insert_ignore(rows, keys, order)


def upsert(base: str, name: str, rows: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> None:
    """Last write wins per key; the columns ``keep`` stay as first written."""
    Store(rows.sparkSession, f"{base}/{name}").upsert(rows, keys, order, keep)


def upsert_entities(base: str, rows: DataFrame) -> None:
    """Entities by natural key, the lower-cased name and the type: id and created_at stay, the rest is overwritten."""
    keyed = rows.withColumn("name_key", F.lower("canonical_name"))
    upsert(base, "entities", keyed, ["name_key", "entity_type"], "updated_at", ("id", "created_at"))


def append_once(base: str, name: str, rows: DataFrame, key: str) -> None:
    """Append the rows whose ``key`` is new, so an append that is repeated after a failure adds nothing."""
    insert_ignore(base, name, rows, [key], key)


def log_status(base: str, rows: DataFrame) -> None:
    """processing_log rows (email_id, extraction_version, status, result, error, processed_at): one a message and version, the latest."""
    upsert(base, "processing_log", rows, ["email_id", "extraction_version"], "processed_at")


def store_embeddings(base: str, rows: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> None:
    """(id, text) rows embedded by ``embed`` and written by id, so a text that changed replaces its vector."""
    fresh = embed(rows).withColumn("written_at", F.current_timestamp())
    upsert(base, "embeddings", fresh, ["id"], "written_at")


def reverse_merges(base: str, reversals: DataFrame) -> None:
    """Mark merge events (id) as reversed, at a time and for a reason; what is marked stays as it is."""
    Store(reversals.sparkSession, f"{base}/merge_events").merge(reversals, ["id"], writes.reversed_merges)


def truncate(spark: SparkSession, base: str) -> None:
    """Empty every table that exists, those that refer to others first."""
    for name in TABLES:
        store = Store(spark, f"{base}/{name}")
        if store.manifest() is not None:
            store.replace(store.read().limit(0))


def export_graph(path: str, entities: DataFrame, claims: DataFrame, evidence: DataFrame, stats: DataFrame, min_confidence: float = 0.0, include_historical: bool = True) -> None:
    """JSON lines below ``path``: nodes, edges (most confident first), evidence_map and stats."""
    some = claims.filter(F.col("confidence") >= min_confidence)
    some = some if include_historical else some.filter("is_current")
    entities.write.mode("overwrite").json(f"{path}/nodes")
    edges = some.withColumnsRenamed({"claim_id": "id", "subject_id": "source", "object_id": "target"})
    edges.orderBy(F.desc("confidence"), "id").write.mode("overwrite").json(f"{path}/edges")
    found = evidence.join(some.select("claim_id"), "claim_id", "left_semi")
    found.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in evidence.columns if c != "claim_id"]))).alias("evidence")).write.mode("overwrite").json(f"{path}/evidence_map")
    stats.write.mode("overwrite").json(f"{path}/stats")


def export_packs(path: str, packs: DataFrame) -> None:
    """Context packs as JSON lines, with an index of their sizes."""
    packs.write.mode("overwrite").json(f"{path}/packs")
    sizes = packs.select("question_id", "question", F.size("entities").alias("entities"), F.size("claims").alias("claims"), F.size("conflicts").alias("conflicts"), "total_evidence_count")
    sizes.write.mode("overwrite").json(f"{path}/index")
