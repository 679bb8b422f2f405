"""What lists, queues and drawings of the graph show: pages, gates, bands, queues, edges and nodes to draw, counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators import graph
from emberline.operators.folding import KEY
from emberline.operators.writes import unprocessed

#: Least confidence of the two upper bands, and of a claim that nobody need review; the size of a node.
HIGH, MEDIUM, REVIEWED = 0.8, 0.5, 0.5
NODE, EDGE, MOST = 8, 3, 24


def _counted(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def list_entities(entities: DataFrame, entity_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the entities, of one type or of all, by name (nulls first) and id."""
    some = entities if entity_type is None else entities.filter(F.col("entity_type") == entity_type)
    return some.orderBy(F.asc_nulls_first("canonical_name"), "id").offset(offset).limit(limit)


def entity_types(entities: DataFrame) -> DataFrame:
    """(entity_type): the types that occur, each once, in order; null is none."""
    return entities.select("entity_type").filter("entity_type IS NOT NULL").distinct().orderBy("entity_type")


def confident(claims: DataFrame, least: float) -> DataFrame:
    """The claims of at least this confidence; one without any is left out."""
    return claims.filter(F.col("confidence") >= least)


def review_queue(claims: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` (1 to 200) least confident of the claims that await review, of equal ones the latest, then the smallest id.

    A column ``pending_review`` says which wait; where there is none, those below ``REVIEWED`` do.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie in 1 to 200")
    waits = F.col("pending_review") if "pending_review" in claims.columns else F.col("confidence") < REVIEWED
    return claims.filter(waits).orderBy("confidence", F.desc_nulls_last("valid_from"), "claim_id").limit(limit)


def as_of(claims: DataFrame, at: date | datetime) -> DataFrame:
    """The claims that hold at a time: begun by then and not ended. Without a start a claim has not begun; without an end it goes on."""
    return claims.filter((F.col("valid_from") <= F.lit(at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(at))))


def band(confidence: Column) -> Column:
    """high, medium or low; of no confidence: low."""
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def drawn_edges(claims: DataFrame) -> DataFrame:
    """(id, source, target, type, confidence, label) of every claim."""
    kind = F.col("claim_type")
    return claims.select(F.col("claim_id").alias("id"), F.col("subject_id").alias("source"), F.col("object_id").alias("target"), kind.alias("type"), "confidence", kind.alias("label"))


def drawn_nodes(entities: DataFrame) -> DataFrame:
    """(id, label, type, aliases) of every entity; without aliases an empty list."""
    return entities.select("id", F.col("canonical_name").alias("label"), F.col("entity_type").alias("type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def drawn_sizes(claims: DataFrame) -> DataFrame:
    """(entity_id, degree, size) of every entity that has a claim; a claim counts once an entity."""
    return graph.degrees(claims).select("entity_id", F.col("claim_count").alias("degree"), (F.lit(NODE) + F.least(EDGE * F.col("claim_count"), F.lit(MOST))).alias("size"))


def top_entities(entities: DataFrame, claims: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` entities with the most claims, with claim_count; of equal ones the smallest ids. An entity without claims counts 0."""
    counts = graph.degrees(claims).withColumnRenamed("entity_id", "id")
    found = entities.join(counts, "id", "left").withColumn("claim_count", F.coalesce("claim_count", F.lit(0).cast("long")))
    return found.orderBy(F.desc("claim_count"), "id").limit(limit)


def queued(emails: DataFrame, log: DataFrame, version: str, limit: int | None = None) -> DataFrame:
    """The messages that are not completed under this version, the earliest ``date`` first, undated ones last, then by id."""
    found = unprocessed(emails, log, version).orderBy(F.asc_nulls_last("date"), "message_id")
    return found if limit is None else found.limit(limit)


def sourced(evidence: DataFrame, emails: DataFrame) -> DataFrame:
    """``evidence`` with the email_sender and email_subject of its message (source_id: message_id), by source_date, undated last.

    Where evidence has no source_date it takes the message's ``date``. An unknown message leaves nulls.
    """
    dated = "source_date" in evidence.columns
    mails = emails.select(F.col("message_id").alias("source_id"), F.col("sender").alias("email_sender"), F.col("subject").alias("email_subject"), *([] if dated else [F.col("date").alias("source_date")]))
    return evidence.join(mails, "source_id", "left").orderBy(F.asc_nulls_last("source_date"), "claim_id")


def repeated(claims: DataFrame) -> DataFrame:
    """The claims whose subject, type and object another claim has too (nulls are equal)."""
    groups = repeated_groups(claims).select(*[F.col(c).alias(f"_{c}") for c in KEY])
    same = [claims[c].eqNullSafe(groups[f"_{c}"]) for c in KEY]
    return claims.join(groups, same, "left_semi")


def repeated_groups(claims: DataFrame) -> DataFrame:
    """(subject, type, object, n, confidence, first_id) of those that several claims share: how many, the best confidence, the smallest id."""
    return claims.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.min("claim_id").alias("first_id")).filter("n > 1")


def first_of(rows: DataFrame, *keys: str, order: str | Column, best: Column | None = None) -> DataFrame:
    """Of the rows with equal ``keys`` (nulls are equal) the one with the greatest ``best``, of these the first by ``order``."""
    place = Window.partitionBy(*keys).orderBy(*([] if best is None else [F.desc_nulls_last(best)]), order)
    return rows.withColumn("_k", F.row_number().over(place)).filter("_k = 1").drop("_k")


def _name(keys: Sequence[str]) -> Column:
    """A text that is equal where all of the keys are, of few bytes however long they are; null is a value of its own."""
    return F.concat_ws(",", *[F.coalesce(F.sha2(F.col(k).cast("string"), 256), F.lit("null")) for k in keys])


def exact_events(emails: DataFrame, *keys: str, order: str = "message_id") -> tuple[DataFrame, DataFrame]:
    """(kept, events) of messages of which some have equal ``keys`` (nulls are equal): the first by ``order``, which is unique, stays.

    events: (duplicate_id, canonical_id, similarity), one a message that goes. Only ids and hashes of the keys are shuffled; a group of
    very many copies is summed up before it moves.
    """
    hashed = emails.select(F.col(order).alias("_id"), _name(keys).alias("_name"))
    first = hashed.groupBy("_name").agg(F.min("_id").alias("_first"))
    kept = emails.join(first.select("_first"), emails[order] == F.col("_first"), "left_semi")
    gone = hashed.join(first, "_name").filter("_id != _first")
    return kept, gone.select(F.col("_id").alias("duplicate_id"), F.col("_first").alias("canonical_id"), F.lit(1.0).alias("similarity"))


def parse_stats(emails: DataFrame, *keys: str) -> DataFrame:
    """One row: total, unique (different ``keys``, null being a value), duplicates, senders (without null)."""
    found = emails.select("sender", _name(keys).alias("_name"))
    found = found.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("_name").alias("unique"), F.count_distinct("sender").alias("senders"))
    return found.select("total", "unique", (F.col("total") - F.col("unique")).alias("duplicates"), "senders")


def rollup(messages: DataFrame, thread: str = "thread_id", order: str = "date") -> DataFrame:
    """(thread, size, participants, first, last, subject) of every thread.

    ``messages``: the thread's column, message_id, ``order``, and of sender, recipients and subject what there is. Participants are the different
    senders and recipients; subject is the first by ``order`` and id (undated ones last) that is not empty.
    """
    there = lambda c, kind: F.col(c) if c in messages.columns else F.lit(None).cast(kind)
    who = F.array_compact(F.array_append(F.coalesce(there("recipients", "array<string>"), F.array().cast("array<string>")), there("sender", "string")))
    rows = messages.select(thread, "message_id", F.col(order).alias("_at"), there("subject", "string").alias("_subject"), who.alias("_who"))
    told = F.when(F.trim("_subject") != "", F.struct(F.col("_at").isNull(), "_at", "message_id"))
    sizes = rows.groupBy(thread).agg(F.count(F.lit(1)).alias("size"), F.min("_at").alias("first"), F.max("_at").alias("last"), F.min_by("_subject", told).alias("subject"))
    people = rows.select(thread, F.explode("_who").alias("_who")).distinct().groupBy(F.col(thread).alias("_t")).agg(F.count(F.lit(1)).alias("participants"))
    found = sizes.join(people, F.col(thread).eqNullSafe(F.col("_t")), "left")
    return found.select(thread, "size", F.coalesce("participants", F.lit(0).cast("long")).alias("participants"), "first", "last", "subject")


def thread_stats(messages: DataFrame, thread: str = "thread_id") -> DataFrame:
    """One row: threads, avg_size, max_size; of no messages 0, null, null."""
    sizes = messages.groupBy(thread).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("threads"), F.avg("n").alias("avg_size"), F.max("n").alias("max_size"))


def type_counts(claims: DataFrame) -> DataFrame:
    """(claim_type, n, current_claims, avg_confidence) of every type; the mean to four places."""
    return claims.groupBy("claim_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_current").alias("current_claims"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


def log_counts(log: DataFrame, by: str, who: str, name: str) -> DataFrame:
    """(``by``, n, ``name``): rows of a log, and how many different ``who`` are in them, by kind."""
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(who).alias(name))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, n): the number of rows of each table."""
    found = None
    for name, df in tables.items():
        one = _counted(df).select(F.lit(name).alias("name"), "n")
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no tables to count")
    return found


def stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row: the number of rows of each table under its name."""
    return table_counts(tables).agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])
