"""The registry of the engine's own queries and of the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import names
from emberline.operators import mail, neardup, threads, trigram
from emberline.plans import browse_queries, graph_queries, graph_sql, lookup_queries, stream_queries
from emberline.session import table

#: Vectors of a block of rows and of a block of queries.
ROW_BLOCK, QUERY_BLOCK = 1024, 512


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: for every vector with an id divisible by 100, the ten other vectors nearest by cosine; zero vectors have no direction and are left out."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    q = e.filter("vec_id % 100 = 0")
    rows, queries = max(1, -(-e.count() // ROW_BLOCK)), max(1, -(-q.count() // QUERY_BLOCK))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("vec_id", "embedding", own(queries).alias("i"), every(rows).alias("j"))
    right = e.select("vec_id", "embedding", every(queries).alias("i"), own(rows).alias("j"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        """The ten best of a block of rows for each of a block of queries."""
        out: list[list] = [[], [], []]
        if a.num_rows and b.num_rows:
            x, y = (np.array(t.column("embedding").to_pylist(), np.float64) for t in (a, b))
            of, to = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
            with np.errstate(invalid="ignore", divide="ignore"):
                found = np.round(x @ y.T / np.sqrt(np.outer((x * x).sum(1), (y * y).sum(1))), 6)
            for k, line in enumerate(found):
                at = np.flatnonzero(np.isfinite(line) & (to != of[k]))
                at = at[np.lexsort((to[at], -line[at]))[:10]]
                for held, more in zip(out, ([of[k]] * len(at), to[at], line[at]), strict=True):
                    held.extend(more)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "similarity"])

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "query_id long, vec_id long, similarity double")
    return _ten(found, "vec_id")


def _ten(found: DataFrame, to: str) -> DataFrame:
    """The ten most similar rows of each query, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), to)
    return found.withColumn("k", F.row_number().over(order)).filter("k <= 10").drop("k")


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", mail.drop_reason(F.col("lang"), F.lit(""), F.col("text")).alias("reason"))


def signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many messages pass the signal filter, and why others do not."""
    return mail.filter_stats(_reasons(spark, sf_dir))


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different five-character shingles a text has."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(names.char_shingles(F.col("text"))).cast("long").alias("n"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first address of a text, of texts that have one."""
    found = table(spark, sf_dir, "documents").select("doc_id", names.email_addresses(F.array("text")).alias("a"))
    return found.filter(F.size("a") > 0).select("doc_id", F.get("a", F.lit(0)).alias("address"))


def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: for every part with a key divisible by 100, the ten other parts whose names are most like its by trigrams, above 0.3."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    asked = parts.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("name").alias("q"))
    # parts of one name are equally like: of each name only the first ten, and the one that asks, can be among the ten
    first = parts.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("id"))).filter("k <= 11").drop("k")
    pairs = trigram.similar_names(asked.select(F.col("q").alias("name")), parts).select("q", "name", F.round("similarity", 6).alias("similarity"))
    found = asked.join(pairs, "q").join(first, "name").filter("id != query_id").select("query_id", "id", "similarity")
    return _ten(found, "id")


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, a, b, similarity. 'pair': different texts, each by the smallest doc_id that has it, whose shingles have
    Jaccard similarity 0.85 or more. 'member': every document b and the smallest doc_id a of its text."""
    docs = table(spark, sf_dir, "documents")
    pairs = neardup.near_pairs(docs).select(F.lit("pair").alias("kind"), "a", "b", F.round("similarity", 6).alias("similarity"))
    return pairs.unionByName(neardup.distinct_texts(docs).select(F.lit("member").alias("kind"), F.col("node").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message and the one that it is a near copy of."""
    return neardup.near_dedup(table(spark, sf_dir, "documents"))


def reply_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: threads of conversations, each turn being a reply to the one before."""
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    none = F.lit(None)
    emails = table(spark, sf_dir, "conversations").select(
        name(F.col("turn")).alias("message_id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("in_reply_to"), none.cast("array<string>").alias("references"),
        F.col("role").alias("sender"), none.cast("array<string>").alias("recipients"), F.lit("").alias("subject"), none.cast("timestamp").alias("date"),
    )
    return threads.build_threads(emails)


OWN = {
    "v2_knn": knn,
    "f1_signal_filter": _reasons,
    "f2_signal_stats": signal_stats,
    "t2_shingle_counts": shingle_counts,
    "t6_email_addresses": addresses,
    "v3_trigram_search": trigram_search,
    "j8_near_pairs": near_pairs,
    "g4_near_dedup": near_dedup,
    "g1_reply_threads": reply_threads,
}
_REASON_SQL = rf"""SELECT doc_id, CASE WHEN {" OR ".join(f"contains(lower(lang), '{x}')" for x in mail.SKIP_FOLDERS)} THEN 'folder'
WHEN length(regexp_replace(coalesce(text, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) < 50 THEN 'length'
WHEN {" + ".join(f"CAST(contains(lower(coalesce(text, '')), '{k}') AS INT)" for k in mail.KEYWORDS)} < 2 THEN 'signal' END AS reason FROM documents"""
_SHINGLES = "SELECT DISTINCT doc_id, substr(x, CAST(i AS INT), 5) AS s FROM (SELECT doc_id, x, unnest(range(1, greatest(length(x) - 4, 1) + 1)) AS i FROM texts)"
OWN_SQL = {
    "v2_knn": """
WITH met AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, vec_id, similarity FROM met WHERE isfinite(similarity) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 10""",
    "f1_signal_filter": _REASON_SQL,
    "f2_signal_stats": f"""WITH r AS ({_REASON_SQL}) SELECT count(*) AS input, count(*) FILTER (reason IS NULL) AS passed, count(*) FILTER (reason = 'folder') AS dropped_folder,
count(*) FILTER (reason = 'length') AS dropped_length, count(*) FILTER (reason = 'signal') AS dropped_signal, round(100 * (1 - count(*) FILTER (reason IS NULL) / greatest(count(*), 1)), 1) AS reduction_pct FROM r""",
    "t2_shingle_counts": rf"""WITH texts AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS x FROM documents) SELECT doc_id, count(*) AS n FROM ({_SHINGLES}) GROUP BY doc_id""",
    "t6_email_addresses": r"""SELECT doc_id, a AS address FROM (SELECT doc_id, regexp_extract(lower(coalesce(text, '')), '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+') AS a FROM documents) WHERE a <> ''""",
    "v3_trigram_search": r"""WITH grams AS (SELECT id, unnest(list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS g FROM (SELECT p_partkey AS id, p_name AS name FROM part)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id), met AS (SELECT q.id AS query_id, a.id, count(*) AS k FROM grams a JOIN grams q ON q.g = a.g AND q.id % 100 = 0 AND a.id <> q.id GROUP BY q.id, a.id),
found AS (SELECT query_id, met.id, round(k / (s.n + q.n - k), 6) AS similarity FROM met JOIN sizes s ON s.id = met.id JOIN sizes q ON q.id = query_id)
SELECT query_id, id, similarity FROM found WHERE similarity > 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10""",
    "g1_reply_threads": """WITH m AS (SELECT concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS message_id, conv_id, turn - dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)
SELECT DISTINCT message_id, min(message_id) OVER (PARTITION BY conv_id, run) AS thread_id FROM m""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return browse_queries.QUERIES | OWN | graph_queries.QUERIES | lookup_queries.QUERIES | stream_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: graph_sql.text(name) for name in graph_sql.OPERATORS} | OWN_SQL | graph_queries.SQL | lookup_queries.SQL | stream_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context packs of some questions: entities, claims with evidence, conflicts."""
    return graph_queries.packs(spark, sf_dir)
