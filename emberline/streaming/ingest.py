"""Streaming forms of the batch operators: insert-ignore, subject sessions and resumable processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_per_message(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each message_id once within the watermark on ``date``; state is dropped behind it."""
    return stream.withWatermark("date", delay).dropDuplicatesWithinWatermark(["message_id"])


def subject_sessions(stream: DataFrame, gap: str = "7 days", delay: str = "7 days") -> DataFrame:
    """(subject, opened, closed, messages) of runs of one subject without a longer gap."""
    grouped = stream.withWatermark("date", delay).groupBy("subject", F.session_window("date", gap).alias("s"))
    return grouped.agg(F.count(F.lit(1)).alias("messages")).select("subject", F.col("s.start").alias("opened"), F.col("s.end").alias("closed"), "messages")


def process_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand what is new since the last call to ``each`` (batch, number), then stop; a batch repeats until it has succeeded."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
