"""Writes as DataFrames: what a keyed insert, upsert, log or re-pointing leaves in a table. The caller writes the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks; of several new rows of one key the first by ``order``."""
    first = Window.partitionBy(*keys).orderBy(order)
    fresh = new.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    return old.unionByName(fresh.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Last write wins per key by ``order``; the columns ``keep`` stay as first written."""
    both = old.select("*", F.lit(0).alias("_new")).unionByName(new.select(*old.columns, F.lit(1).alias("_new")))
    at = F.struct("_new", order)
    rest = [c for c in old.columns if c not in keys]
    # one aggregate for all columns: what is shuffled has the order once
    last, first = ([c for c in rest if (c in keep) == kept] for kept in (False, True))
    found = both.groupBy(*keys).agg(F.max_by(F.struct(*last, "_new"), at).alias("_last"), *([F.min_by(F.struct(*first), at).alias("_first")] if first else []))
    return found.select(*[F.col(c if c in keys else f"_first.`{c}`" if c in keep else f"_last.`{c}`").alias(c) for c in old.columns])


def reversed_merges(events: DataFrame, reversals: DataFrame) -> DataFrame:
    """Merge events with ``reversed_at`` and ``reversed_reason`` set by the first reversal (id, at, reason) of each."""
    first = reversals.groupBy("id").agg(F.min("at").alias("_at"), F.min_by("reason", "at").alias("_why"))
    rest = [c for c in events.columns if c not in ("reversed_at", "reversed_reason")]
    return events.join(first, "id", "left").select(*rest, F.coalesce("reversed_at", "_at").alias("reversed_at"), F.coalesce("reversed_reason", "_why").alias("reversed_reason"))


def repoint(rows: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the ids in ``columns`` replaced through ``mapping`` (source_id, canonical_id), one row a source_id."""
    names = rows.columns
    for c in columns:
        step = mapping.select(F.col("source_id").alias(c), F.col("canonical_id").alias("_to"))
        rows = rows.join(step, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return rows.select(*names)


def unprocessed(emails: DataFrame, log: DataFrame, version: str) -> DataFrame:
    """Messages that the log does not list as completed under this version."""
    done = log.filter((F.col("extraction_version") == version) & (F.col("status") == "completed")).select(F.col("email_id").alias("message_id"))
    return emails.join(done, "message_id", "left_anti")
