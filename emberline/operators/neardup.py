"""Exact near-duplicate pairs by bitmaps of shingle sets, and greedy leaders over them. Equal texts are one node, so copies never form pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators import setjoin
from emberline.session import checkpointed, scratch, stored


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (id, node): the smallest doc_id of the same text; a null text counts as empty."""
    rows = docs.select(docs["doc_id"].alias("id"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256).alias("h")).filter("id IS NOT NULL")
    least = rows.groupBy("h").agg(F.min("id").alias("node"))
    return rows.join(least, "h").select("id", "node").distinct()


def near_pairs(docs: DataFrame, threshold: float = 0.85, k: int = 5) -> DataFrame:
    """(a, b, similarity), a < b: every pair of different texts, by their smallest doc_id, whose k-shingles reach ``threshold``."""
    with scratch(docs.sparkSession) as own:
        sets = setjoin.prints(docs, k)
        return own.result(setjoin.pairs_inside(docs, sets, setjoin.close_pairs(sets, threshold), threshold, k), "near-pairs")


def greedy_leaders(pairs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(a, b), a before b -> (id, canonical) of absorbed nodes: in ascending order, a node that no earlier leader absorbs leads.

    A round settles all nodes without an earlier open neighbour at once, which gives what one pass in order would.
    """
    whole = checkpointed(pairs.select("a", "b").distinct())
    left, gone = whole, []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        lead = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        taken = checkpointed(left.join(lead, "a").select("b").distinct())
        gone.append(taken)
        left = checkpointed(left.join(taken, "b", "left_anti").join(taken.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"))
    else:
        raise RuntimeError(f"leaders did not settle in {max_rounds} rounds")
    if not gone:
        return whole.select(F.col("b").alias("id"), F.col("a").alias("canonical"))
    absorbed = reduce(DataFrame.unionByName, gone)
    by = whole.join(absorbed.select(F.col("b").alias("a")), "a", "left_anti")
    return by.join(absorbed, "b").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("canonical"))


def near_dedup(docs: DataFrame, threshold: float = 0.85, k: int = 5, order: str | None = None) -> DataFrame:
    """(doc_id, canonical_id) of every doc_id of ``docs`` (doc_id, text); canonical_id equals doc_id where it stays.

    Of a group the first stays: by doc_id, or by the timestamp column ``order`` (nulls first), then doc_id.
    """
    if order:
        at = F.coalesce(docs[order].cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
        timed = docs.filter("doc_id IS NOT NULL").select(F.struct(at.alias("at"), docs["doc_id"].alias("id")).alias("doc_id"), "text")
        return near_dedup(timed, threshold, k).select(F.col("doc_id.id").alias("doc_id"), F.col("canonical_id.id").alias("canonical_id"))
    nodes = distinct_texts(docs)
    lead = greedy_leaders(near_pairs(docs, threshold, k)).withColumnRenamed("id", "node")
    return nodes.join(lead, "node", "left").select(F.col("id").alias("doc_id"), F.coalesce("canonical", "node").alias("canonical_id"))


def dedup_outcome(emails: DataFrame, key: Column, threshold: float = 0.85, k: int = 5, order: str | None = None) -> DataFrame:
    """One row: input, after_exact_dedup, after_near_dedup, exact_dups_removed, near_dups_removed.

    Of the ``emails`` (doc_id unique and not null, text) with one ``key`` the first stays, by ``order`` (nulls first) and doc_id; near copies are looked for among those.
    """
    with scratch(emails.sparkSession) as own:
        at = F.col(order) if order else F.lit(0)
        first = emails.withColumn("_k", key).groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(at.alias("at"), "doc_id")).alias("first"), F.min_by("text", F.struct(at, "doc_id")).alias("text"))
        kept = stored(first.select("n", F.col("first.at").alias("at"), F.col("first.doc_id").alias("doc_id"), "text"), "exact")
        near = near_dedup(kept.select("doc_id", "text", "at"), threshold, k, "at" if order else None)
        counts = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input"), F.count(F.lit(1)).alias("after_exact_dedup"))
        counts = counts.join(near.agg(F.count_if(F.col("doc_id") == F.col("canonical_id")).alias("after_near_dedup")), how="cross")
        gone = [(F.col("input") - F.col("after_exact_dedup")).alias("exact_dups_removed"), (F.col("after_exact_dedup") - F.col("after_near_dedup")).alias("near_dups_removed")]
        return own.result(counts.select("*", *gone), "dedup-outcome")
