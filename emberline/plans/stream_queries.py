"""Registered queries of streams, replayed from the tables as files in several batches, and of indexes; SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import ann, conflicts, constraints, folding, lsh, neardup
from emberline.operators.store import Store
from emberline.plans import graph_queries
from emberline.session import remove, scratch, setting, shared_dir, stored, table
from emberline.streaming import threads, windows

BATCHES = 3


@contextmanager
def _replayed(spark: SparkSession, rows: DataFrame) -> Iterator[tuple[DataFrame, str]]:
    """``rows`` as a stream of files in BATCHES batches, dealt by hash, and a folder for state; both are deleted afterwards."""
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    try:
        with scratch(spark):
            dealt = stored(rows.withColumn("_batch", F.pmod(F.xxhash64(*rows.columns), F.lit(BATCHES))), "dealt")
            for k in range(BATCHES):
                dealt.filter(F.col("_batch") == k).drop("_batch").write.parquet(f"{base}/in/{k}")
        files = max(1, -(-len(spark.read.parquet(f"{base}/in/*").inputFiles()) // BATCHES))
        yield spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in/*"), base
    finally:
        remove(spark, base)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: the windows of all current claims of exclusive types, kept by a stream that sees the claims in another order."""
    claims = graph_queries.role(spark, sf_dir, "claims").withColumn("seen_at", F.lit(None).cast("timestamp"))
    # what the stream passes over need not be staged for it
    claims = folding.started(claims).select("claim_id", "subject_id", "claim_type", F.col("valid_from").cast("timestamp").alias("valid_from"), F.col("valid_to").cast("timestamp").alias("valid_to"), "is_current", "seen_at")
    # state is mostly ids of digits, which zstd packs and lz4 does not
    store = "spark.sql.streaming.stateStore"
    with setting(spark, f"{store}.providerClass", windows.PROVIDER), setting(spark, f"{store}.rocksdb.compression", "zstd"), setting(spark, "spark.sql.parquet.compression.codec", "zstd"):
        with scratch(spark) as own, _replayed(spark, claims) as (stream, base):
            windows.keep_windows(stream, f"{base}/windows", f"{base}/checkpoint").awaitTermination()
            for part in ("in", "checkpoint"):  # the stream has ended
                remove(spark, f"{base}/{part}")
            kept = Store(spark, f"{base}/windows").read()
            day = lambda c: F.col(c).cast("date").alias(c)
            return own.result(kept.select("claim_id", "subject_id", "claim_type", day("valid_from"), day("valid_to"), "is_current"), "windows")


def stream_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: threads of conversations, each turn being a reply to the one before, kept up to date by batches in another order."""
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    none = F.lit(None)
    mails = table(spark, sf_dir, "conversations").select(
        name(F.col("turn")).alias("message_id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("in_reply_to"), none.cast("array<string>").alias("references"),
        F.col("role").alias("sender"), none.cast("array<string>").alias("recipients"), F.lit("").alias("subject"), none.cast("timestamp").alias("date"),
    )
    with scratch(spark) as own, _replayed(spark, mails) as (stream, base):
        threads.keep_threads(stream, f"{base}/state", f"{base}/checkpoint").awaitTermination()
        return own.result(threads.Threads(spark, f"{base}/state").read(), "threads")


def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, signature (128 minima) of every different text, by its smallest doc_id."""
    return lsh.text_signatures(table(spark, sf_dir, "documents")).select(F.col("node").alias("doc_id"), F.col("minima").alias("signature"))


def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 by MinHash bands: kind, a, b, similarity, as ``j8_near_pairs`` gives them by the exact join."""
    docs = table(spark, sf_dir, "documents")
    pairs = lsh.near_pairs(docs).select(F.lit("pair").alias("kind"), "a", "b", F.round("similarity", 6).alias("similarity"))
    return pairs.unionByName(neardup.distinct_texts(docs).select(F.lit("member").alias("kind"), F.col("node").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 by an inverted file: for every vector with an id divisible by 100, ten near ones among all; query_id, vec_id, similarity."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    with scratch(spark) as own:
        centres = ann.fit(e)
        listed = stored(ann.index(e, centres), "lists")
        found = ann.search(listed, e.filter("id % 100 = 0"), centres)
        return own.result(found.select("query_id", F.col("id").alias("vec_id"), "similarity"), "nearest")


def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9 as counts: claim_id, conflicts of every claim that conflicts with others."""
    return conflicts.conflict_counts(graph_queries.role(spark, sf_dir, "claims")).select("claim_id", "conflicts")


def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, claim_id, source_id, rules of evidence and log rows in quarantine: sources that do not exist, keys that repeat."""
    evidence = graph_queries.role(spark, sf_dir, "evidence").select("claim_id", "source_id")
    known = {"claim_id": (graph_queries.role(spark, sf_dir, "claims"), "claim_id"), "source_id": (table(spark, sf_dir, "orders"), "o_orderkey")}
    _, bad = constraints.split(constraints.broken(evidence, constraints.checks("evidence"), ["claim_id"], known))
    log = graph_queries.role(spark, sf_dir, "log").select("email_id", "extraction_version", "status")
    _, worse = constraints.split(constraints.broken(log, constraints.checks("processing_log"), ["email_id", "extraction_version"]))
    joined = F.array_join("broken", ",").alias("rules")
    first = bad.select(F.lit("evidence").alias("kind"), "claim_id", "source_id", joined)
    return first.unionByName(worse.select(F.lit("log").alias("kind"), F.col("extraction_version").alias("claim_id"), F.col("email_id").alias("source_id"), joined))


QUERIES = {
    "f18_broken_rules": broken_rules,
    "g9_conflict_counts": conflict_counts,
    "st3_stream_windows": stream_windows,
    "st5_stream_threads": stream_threads,
    "t3_minhash_signatures": minhash_signatures,
    "j8_lsh_pairs": lsh_pairs,
    "v2_ivf": ivf,
}
SQL = {
    "f18_broken_rules": graph_queries.with_roles(
        "claims evidence log",
        """SELECT 'evidence' AS kind, claim_id, source_id,
  CASE WHEN again AND lost THEN 'key_repeated,source_id_unknown' WHEN again THEN 'key_repeated' ELSE 'source_id_unknown' END AS rules
FROM (SELECT claim_id, source_id, count(*) OVER (PARTITION BY claim_id) > 1 AS again, source_id NOT IN (SELECT o_orderkey FROM orders) AS lost FROM evidence) e WHERE again OR lost
UNION ALL SELECT 'log', extraction_version, email_id, 'key_repeated' FROM (SELECT *, count(*) OVER (PARTITION BY email_id, extraction_version) AS n FROM log) l WHERE n > 1""",
    ),
    "g9_conflict_counts": graph_queries.with_roles(
        "claims",
        """SELECT a.claim_id, count(*) AS conflicts FROM claims a JOIN claims b ON a.subject_id = b.subject_id AND a.claim_type = b.claim_type AND a.object_id <> b.object_id
AND coalesce(a.valid_from, DATE '0001-01-01') <= coalesce(b.valid_to, DATE '9999-12-31') AND coalesce(b.valid_from, DATE '0001-01-01') <= coalesce(a.valid_to, DATE '9999-12-31') GROUP BY a.claim_id""",
    ),
    "st3_stream_windows": graph_queries.with_roles(
        "claims",
        """SELECT claim_id, subject_id, claim_type, valid_from, lead(valid_from) OVER w AS valid_to, lead(claim_id) OVER w IS NULL AS is_current
FROM (SELECT DISTINCT claim_id, subject_id, claim_type, valid_from FROM claims WHERE is_current AND claim_type IN ('WORKS_AT', 'REPORTS_TO')) c
WINDOW w AS (PARTITION BY subject_id, claim_type ORDER BY valid_from, claim_id)""",
    ),
    "st5_stream_threads": """SELECT DISTINCT concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS message_id,
min(concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING))) OVER (PARTITION BY conv_id, run) AS thread_id
FROM (SELECT conv_id, turn, turn - dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations) m""",
}
