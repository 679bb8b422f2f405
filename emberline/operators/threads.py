"""Conversation threads: replies, references and like subjects close in time, as connected components.

Messages of one subject and one set of participants fall into sessions without gaps over ``days``. A session is
connected, and a date inside its span is nearer than ``days`` to one of its messages, so two sessions link exactly
if their spans come that near. Only sessions are joined with each other, never all messages of a subject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.names import jaccard
from emberline.functions.text import normalize_subject
from emberline.operators.components import connected_components
from emberline.session import scratch, stored


def references(emails: DataFrame) -> DataFrame:
    """(message_id, target): every other message that one replies to or refers to, in the corpus or not."""
    to = F.array_union(F.coalesce("references", F.array().cast("array<string>")), F.array("in_reply_to"))
    return emails.select("message_id", F.explode(to).alias("target")).filter("message_id != target").distinct()


def reply_edges(emails: DataFrame) -> DataFrame:
    """(u, v): a message and each message of the corpus that it replies to or refers to."""
    known = emails.select(F.col("message_id").alias("v")).distinct()
    return references(emails).select(F.col("message_id").alias("u"), F.col("target").alias("v")).join(known, "v").select("u", "v")


def sessions(emails: DataFrame, days: int = 7) -> DataFrame:
    """(message_id, date, subject, who, session, first): dated messages of one subject and one set of participants, by sessions."""
    everyone = F.array_union(F.array(F.coalesce("sender", F.lit(""))), F.coalesce("recipients", F.array().cast("array<string>")))
    rows = emails.select("message_id", "date", normalize_subject(F.coalesce("subject", F.lit(""))).alias("subject"), F.sort_array(F.filter(F.array_distinct(everyone), lambda x: x.isNotNull() & (x != ""))).alias("who"))
    rows = rows.filter("message_id IS NOT NULL AND date IS NOT NULL AND subject != '' AND size(who) > 0")
    order = Window.partitionBy("subject", "who").orderBy("date", "message_id")
    gap = F.col("date").cast("long") - F.lag("date").over(order).cast("long")
    rows = rows.withColumn("new", F.coalesce((gap > days * 86400).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(order))
    rows = rows.withColumn("first", F.min("message_id").over(Window.partitionBy("subject", "who", "session")))
    return rows.select("message_id", "date", "subject", "who", "session", "first")


def spans(rows: DataFrame) -> DataFrame:
    """(subject, who, first, lo, hi): the span of every session, in seconds."""
    found = rows.groupBy("subject", "who", "session", "first").agg(F.min("date").cast("long").alias("lo"), F.max("date").cast("long").alias("hi"))
    return found.select("subject", "who", "first", "lo", "hi")


def inside_sessions(rows: DataFrame) -> DataFrame:
    """(u, v): every message of a session and its first one."""
    return rows.filter("message_id != first").select(F.col("message_id").alias("u"), F.col("first").alias("v"))


def near_spans(left: DataFrame, right: DataFrame, days: int = 7, overlap: float = 0.3) -> DataFrame:
    """(u, v): first messages of different spans of one subject, ``days`` apart at most, whose participants overlap."""
    a = left.select("subject", F.explode("who").alias("p"), "who", "first", "lo", "hi")
    b = right.select("subject", F.explode("who").alias("p"), "who", "first", "lo", "hi").toDF("subject", "p", "who2", "first2", "lo2", "hi2")
    near = (F.col("lo2") - F.col("hi") <= days * 86400) & (F.col("lo") - F.col("hi2") <= days * 86400)
    linked = a.join(b, ["subject", "p"]).filter((F.col("first") != F.col("first2")) & near & (jaccard(F.col("who"), F.col("who2")) >= overlap))
    return linked.select(F.greatest("first", "first2").alias("u"), F.least("first", "first2").alias("v")).distinct()


def subject_edges(emails: DataFrame, days: int = 7, overlap: float = 0.3) -> DataFrame:
    """(u, v): links that connect all dated messages of one subject, ``days`` apart at most, whose participants overlap."""
    with scratch(emails.sparkSession) as own:
        rows = stored(sessions(emails, days), "sessions")
        return own.result(inside_sessions(rows).unionByName(near_spans(spans(rows), spans(rows), days, overlap)).distinct(), "subject-edges")


def build_threads(emails: DataFrame) -> DataFrame:
    """(message_id, thread_id) of every message; thread_id is the smallest message_id of its thread."""
    with scratch(emails.sparkSession) as own:
        edges = reply_edges(emails).unionByName(subject_edges(emails))
        found = connected_components(edges).withColumnRenamed("node", "message_id")
        ids = emails.select("message_id").filter("message_id IS NOT NULL").distinct()
        return own.result(ids.join(found, "message_id", "left").select("message_id", F.coalesce("component", "message_id").alias("thread_id")), "threads")
