"""Threads kept up to date as messages arrive, in micro-batches of a stream of files.

State is four tables: the label of every message (the smallest message_id of its thread when it came), the labels that have since merged into
another, the spans of subject sessions, and references to messages that have not come yet. A batch links its messages with each other, with
what waited for them and with the known messages and sessions that they reach; components are computed over the *labels* that these links
touch, and only labels that merge are written. Nothing known is threaded again, and any split into batches ends
in the threads that ``operators.threads.build_threads`` gives of all messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators import threads
from emberline.operators.components import connected_components
from emberline.operators.store import Store
from emberline.session import scratch, stored

#: The schema of arriving files; rows that do not fit are kept apart.
MESSAGE = "message_id string, in_reply_to string, references array<string>, sender string, recipients array<string>, subject string, date timestamp"
COLUMNS = [c.split()[0] for c in MESSAGE.split(", ")]
LABELS, MERGED, WAITING = "message_id string, label string", "label string, into string, at long", "target string, message_id string"
TABLES = ("labels", "merged", "spans", "waiting", "late", "rejected")


class Threads:
    """The state below ``base``."""

    def __init__(self, spark: SparkSession, base: str, days: int = 7, overlap: float = 0.3, delay_days: int | None = None, buckets: int = 16):
        self.spark, self.days, self.overlap, self.delay = spark, days, overlap, delay_days
        self.tables = {name: Store(spark, f"{base}/{name}", buckets) for name in TABLES}

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """(message_id, thread_id) of every message so far."""
        merged = self.tables["merged"].read(self._empty(MERGED)).select("label", "into")
        labels = self.tables["labels"].read(self._empty(LABELS))
        return labels.join(merged, "label", "left").select("message_id", F.coalesce("into", "label").alias("thread_id"))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Thread one batch (columns of MESSAGE).

        A repeated batch leaves the same state. Rows without a message_id are rejected. With ``delay_days`` a message dated more than that
        before the latest of earlier batches is late: it is kept apart, and sessions that no other message can reach are no longer looked at.
        """
        t, spark = self.tables, self.spark
        with scratch(spark):
            rows = stored(rows.select(*COLUMNS), "arrived")
            manifest = t["spans"].manifest(batch)
            newest = (manifest or {}).get("note", {}).get("newest")
            good, bad = rows.filter("message_id IS NOT NULL"), rows.filter("message_id IS NULL")
            late = F.lit(False)
            if self.delay is not None and newest is not None:
                late = F.coalesce(F.col("date").cast("long") < newest - self.delay * 86400, F.lit(False))
            t["rejected"].append(bad, batch)
            t["late"].append(good.filter(late), batch)
            good = good.filter(~late)

            # sessions: those of the batch, linked inside and with the known ones
            sessions = stored(threads.sessions(good, self.days), "sessions")
            spans = stored(threads.spans(sessions), "spans")
            known = t["spans"].read(spans, before=batch).select(*spans.columns)
            if self.delay is not None and newest is not None:
                known = known.filter(F.col("hi") >= newest - (self.delay + self.days) * 86400)
            edges = threads.inside_sessions(sessions).unionByName(threads.near_spans(spans, spans, self.days, self.overlap)).unionByName(threads.near_spans(spans, known, self.days, self.overlap))

            # references: of the batch to whatever is there, and of earlier messages to the batch
            asked = threads.references(good).select("message_id", "target")
            ids = good.select("message_id").distinct()
            had = t["waiting"].lookup(ids.select(F.col("message_id").alias("target")), ["target"], self._empty(WAITING), before=batch)
            waited = had.join(ids.select(F.col("message_id").alias("target")), "target", "left_semi")
            edges = stored(edges.unionByName(asked.unionByName(waited.select("message_id", "target")).select(F.col("message_id").alias("u"), F.col("target").alias("v"))).distinct(), "edges")

            # ends as labels
            ends = edges.select(F.explode(F.array("u", "v")).alias("message_id")).unionByName(ids).distinct()
            have = t["labels"].lookup(ends, ["message_id"], self._empty(LABELS), before=batch).join(ends, "message_id", "left_semi")
            gone = t["merged"].read(self._empty(MERGED), before=batch).select("label", "into")
            have = have.join(gone, "label", "left").select("message_id", F.coalesce("into", "label").alias("label"))
            fresh = ids.join(have, "message_id", "left_anti").withColumn("label", F.col("message_id"))
            label = stored(have.unionByName(fresh), "labels")
            of = lambda end: label.select(F.col("message_id").alias(end), F.col("label").alias(f"l{end}"))
            linked = edges.join(of("u"), "u").join(of("v"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")).filter("u != v").distinct()
            found = stored(connected_components(linked), "found").withColumnRenamed("node", "label")

            new = stored(fresh.join(found, "label", "left").select("message_id", F.coalesce("component", "label").alias("label")), "fresh")
            t["labels"].merge(new, ["message_id"], DataFrame.unionByName, batch)
            moved = found.filter("label != component").join(fresh.select("label"), "label", "left_anti").select("label", F.col("component").alias("into"))
            # labels that had merged into one that moves now follow it
            followed = gone.withColumnRenamed("into", "mid").join(moved.select(F.col("label").alias("mid"), "into"), "mid").select("label", "into")
            t["merged"].upsert(stored(moved.unionByName(followed).withColumn("at", F.lit(batch).cast("long")), "moved"), ["label"], "at", batch=batch)
            open_ = asked.join(label.select(F.col("message_id").alias("target")), "target", "left_anti").select("target", "message_id").distinct()
            t["waiting"].merge(open_, ["target"], DataFrame.unionByName, batch)
            latest = good.agg(F.max(F.col("date").cast("long"))).first()[0]
            t["spans"].append(spans, batch, {"newest": max((x for x in (newest, latest) if x is not None), default=None)})


def keep_threads(files: DataFrame, base: str, checkpoint: str, **how) -> StreamingQuery:
    """Thread what is new in ``files``, a stream of MESSAGE rows, then stop."""

    def each(rows: DataFrame, batch: int) -> None:
        Threads(rows.sparkSession, base, **how).add(rows, batch)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
