"""How many claims each claim conflicts with, without pairing them.

Claims of one subject and type conflict where their windows overlap and their objects differ. A window meets as many others as
start no later than it ends, less those that end before it starts. Both are running sums over starts and ends in order of
time, once within subject and type and once within the object too; their difference counts the conflicts. The points
of a subject with very many claims are dealt into slices of time whose sums are added up first, so it is no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import scratch, stored

#: A subject and type of more claims is dealt into slices.
HOT = 1 << 16
SLICE = 30 * 86400 * 1_000_000  # microseconds
_FIRST, _LAST = -(1 << 62), 1 << 62


def _met(points: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(claim, ``name``): how many windows of the same ``keys`` each window meets, itself among them."""
    is_end = F.col("ends").cast("long")
    parts = points.groupBy(*keys, "slice").agg(F.sum(1 - is_end).alias("s"), F.sum(is_end).alias("e"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "slice", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("e").over(before), F.lit(0)).alias("e0"))
    # at one time starts come before ends, so windows that touch meet
    inside = Window.partitionBy(*keys, "slice").orderBy("at", "ends").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = points.select("*", F.sum(1 - is_end).over(inside).alias("s1"), F.sum(is_end).over(inside).alias("e1"))
    same = rows.join(parts, [*keys, "slice"])
    met = F.sum(F.when(F.col("ends"), F.col("s0") + F.col("s1")).otherwise(-(F.col("e0") + F.col("e1"))))
    return same.groupBy("claim").agg(met.alias(name))


def _ends(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both ends of each window as rows: claim, keys, at, ends."""
    both = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(False).alias("ends")), F.struct(F.col("hi").alias("at"), F.lit(True).alias("ends")))).alias("p")
    return rows.select("claim", *keys, both).select("claim", *keys, "p.at", "p.ends")


def _small_groups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What ``conflict_counts`` gives, where each subject and type fits a task: the claims are shuffled once, for all that follows."""
    points = _ends(rows.repartition(*keys[:2]), keys)
    is_end, other = F.col("ends").cast("long"), F.lit(0)
    for group, sign in ((keys[:2], 1), (keys, -1)):
        upto = Window.partitionBy(*group).orderBy("at", "ends").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        other = other + sign * F.when(F.col("ends"), F.sum(1 - is_end).over(upto)).otherwise(-F.sum(is_end).over(upto))
    met = points.select("claim", *keys, other.alias("k")).groupBy("claim", *keys).agg(F.sum("k").alias("conflicts"))
    return met.filter("conflicts > 0 AND claim IS NOT NULL").select(F.col("claim").alias("claim_id"), *keys, "conflicts")


def conflict_counts(claims: DataFrame) -> DataFrame:
    """(claim_id, subject_id, claim_type, object_id, conflicts) of every claim that conflicts with others.

    ``claims``: claim_id (unique), subject_id, claim_type, object_id, valid_from, valid_to; a null bound is open. A claim that ends before it
    starts takes no part, nor does one without subject, type or object.
    """
    with scratch(claims.sparkSession) as own:
        micros = lambda c, other: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(other))
        keys = ["subject_id", "claim_type", "object_id"]
        rows = claims.select(F.col("claim_id").alias("claim"), *keys, micros("valid_from", _FIRST).alias("lo"), micros("valid_to", _LAST).alias("hi"))
        rows = stored(rows.filter("lo <= hi AND subject_id IS NOT NULL AND claim_type IS NOT NULL AND object_id IS NOT NULL"), "bounds")
        hot = stored(rows.groupBy(keys[:2]).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select(keys[:2]), "hot")
        if hot.isEmpty():
            return own.result(_small_groups(rows, keys), "conflicts")
        found = _small_groups(rows.join(F.broadcast(hot), keys[:2], "left_anti"), keys)
        rows = rows.join(F.broadcast(hot), keys[:2], "left_semi")
        points = _ends(rows, keys).withColumn("slice", F.floor(F.col("at") / F.lit(SLICE)))
        # open bounds share one slice; some digits of the claim spread them, as among equal times only the kind counts
        salt = F.when(F.col("at").isin(_FIRST, _LAST), F.pmod(F.xxhash64("claim"), F.lit(64))).otherwise(F.lit(0))
        points = stored(points.withColumn("slice", F.col("slice") * 64 + salt), "points")
        every, alike = _met(points, keys[:2], "every"), _met(points, keys, "alike")
        met = every.join(alike, "claim").select("claim", (F.col("every") - F.col("alike")).alias("conflicts")).filter("conflicts > 0")
        met = met.join(rows, "claim").select(F.col("claim").alias("claim_id"), *keys, "conflicts")
        return own.result(found.unionByName(met), "conflicts")


def conflict_classes(counts: DataFrame) -> DataFrame:
    """(subject_id, claim_type, claims, objects, links) from ``conflict_counts``: each subject and type with conflicts, and how many pairs conflict."""
    return counts.groupBy("subject_id", "claim_type").agg(F.count(F.lit(1)).alias("claims"), F.count_distinct("object_id").alias("objects"), (F.sum("conflicts") / 2).cast("long").alias("links"))
