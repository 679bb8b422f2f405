"""Mixing sources to target weights along a time-varying curriculum, natively.

Sources, in code-point order with null last, take the given weights in turn. A source's target is its weight's
share of ``share`` times all words, stopped at ``cap`` times its own size; what the stopped ones leave is shared
again by weight until none is above. (The fixed point is min(cap * size, weight * level), and the level follows
from sorting sources by cap * size / weight, so nothing is iterated.)

Over training time t from 0 to 1 each weight follows a schedule w(t) = w * (1 + slope * (2t - 1)). Its integral,
scaled to the target, is the source's cumulative token demand D(t) = target * ((1 - slope) * t + slope * t * t).
A source's documents are laid end to end in hash order, pass after pass; the copy that begins at token c is
trained at the time D(t) = c, and documents are range-sorted by that position.

A hot source is no hot task: its documents are dealt into hash buckets, whose sums are prefixed first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import free_name, only, words_of
from emberline.session import scratch, stored

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, slopes: Sequence[float] = SLOPES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) one row a source -> with weight, slope and target. Only sources are gathered, never documents."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (place + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick(weights, "double")).withColumn("slope", pick(slopes, "double"))
    stop = F.col("source_size") * F.lit(float(cap))
    order = Window.orderBy((stop / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(stop).over(before), F.lit(0.0))
    at = ranked.withColumn("stop", stop).withColumn("at", left / F.sum("weight").over(after))
    level = F.min(F.when(F.col("stop") / F.col("weight") > F.col("at"), F.struct(F.col("stop") / F.col("weight"), F.col("at").alias("at")))).over(every)["at"]
    target = F.coalesce(F.least(F.col("stop"), F.col("weight") * level), F.col("stop"))
    return at.select("source", "source_size", "weight", "slope", target.alias("target"))


def _position(c: Column) -> Column:
    """The time at which the cumulative demand of the source reaches token c."""
    s, part = F.col("slope"), c / F.col("target")
    curved = (F.sqrt((1 - s) * (1 - s) + 4 * s * part) - (1 - s)) / (2 * s)
    return F.when(s == 0, part).otherwise(curved)


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, slopes: Sequence[float] = SLOPES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, copies, taken, positions.

    ``positions`` has the training time of each copy. A copy is taken if its middle lies before the target, so
    a source misses its target by half a document at most, and no document is taken more than ceil(cap) times.
    A null text has size 0; a null source is a source; sources without words take nothing. Documents are laid in
    the order of md5 of their id, so reruns agree; repeated rows are documents of their own.
    """
    with scratch(docs.sparkSession) as own:
        sized = only(docs, "doc_id", "text", "source").select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"))
        key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        sized = stored(sized.withColumn("h", key).withColumn("bucket", F.substring("h", 1, 3)), "sizes")
        parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
        by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("base", F.coalesce(F.sum("part").over(by_bucket), F.lit(0)))
        sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, slopes, share, cap)
        at = parts.join(sources, parts["source"].eqNullSafe(sources["source"])).select(parts["source"], "bucket", "base", "source_size", "slope", "target")
        inside = Window.partitionBy("source", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
        laid = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        laid = laid.join(at, laid["source"].eqNullSafe(at["source"]) & (laid["bucket"] == at["bucket"])).withColumn("start", F.col("base") + F.col("within"))
        begins = [F.col("start") + F.lit(p) * F.col("source_size") for p in range(math.ceil(cap))]
        taken = [b + F.col("size") / F.lit(2.0) < F.col("target") for b in begins]
        copies = sum((t.cast("int") for t in taken[1:]), taken[0].cast("int"))
        positions = F.filter(F.array(*[F.when(t, _position(b)) for t, b in zip(taken, begins, strict=True)]), lambda x: x.isNotNull())
        return own.result(laid.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), positions.alias("positions")), "mix")


def training_order(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, range-sorted by training position.

    The position is the last column, ``position``, with underscores behind it where ``docs`` has a column of that name.
    Rows that share a doc_id (or have none) all get the positions of the one that the mix takes most often.
    """
    names, position = docs.columns, free_name(docs, "position")
    plan = plan_mix(docs, **how).groupBy("doc_id").agg(F.max_by("positions", F.size("positions")).alias("_positions"))
    plan = plan.select(F.col("doc_id").alias("_doc"), "_positions").filter(F.size("_positions") > 0)
    taken = docs.join(plan, docs["doc_id"].eqNullSafe(plan["_doc"])).select(*[docs[n] for n in names], F.explode(plan["_positions"]).alias(position))
    return taken.repartitionByRange(F.col(position), docs["doc_id"]).sortWithinPartitions(F.col(position), docs["doc_id"])
