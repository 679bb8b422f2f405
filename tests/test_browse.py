"""Lists, queues, drawings and counts against hand values: nulls, ties, repeated rows, empty tables."""

from datetime import date

import pytest
from emberline.operators import browse
from pyspark.sql import functions as F

CLAIMS = "claim_id string, subject_id string, claim_type string, object_id string, confidence double, is_current boolean, valid_from date, valid_to date"
D = date


def claims(spark):
    rows = [
        ("1", "a", "T", "b", 0.8, True, D(2000, 1, 1), None),
        ("2", "a", "T", "b", 0.8, True, D(2001, 1, 1), D(2002, 1, 1)),
        ("3", "a", "U", "a", 0.49, False, None, None),
        ("4", None, "T", "b", 0.3, None, D(2000, 1, 1), D(2000, 1, 1)),
        ("5", None, "T", "b", None, True, D(1999, 1, 1), D(2003, 1, 1)),
        ("6", "b", "T", "a", 0.49, True, D(2000, 5, 1), None),
    ]
    return spark.createDataFrame(rows, CLAIMS)


def ids(df, c="claim_id"):
    return [r[c] for r in df.collect()]


def test_gates_and_queue(spark):
    rows = claims(spark)
    assert ids(browse.confident(rows, 0.49)) == ["1", "2", "3", "6"]
    assert ids(browse.review_queue(rows)) == ["4", "6", "3"]  # the later of two equal ones first, undated last
    assert ids(browse.review_queue(rows, 1)) == ["4"]
    assert ids(browse.review_queue(rows.withColumn("pending_review", F.col("claim_id") > "4"))) == ["5", "6"]
    for bad in (0, 201):
        with pytest.raises(ValueError):
            browse.review_queue(rows, bad)
    assert ids(browse.as_of(rows, D(2000, 1, 1))) == ["1", "5"]  # what ends that day has ended
    assert [r.b for r in rows.select(browse.band(F.col("confidence")).alias("b")).collect()] == ["high", "high", "low", "low", "low", "low"]
    assert browse.review_queue(rows.limit(0)).count() == 0


def test_repeats(spark):
    rows = claims(spark)
    assert sorted(ids(browse.repeated(rows))) == ["1", "2", "4", "5"]
    groups = {(r.subject_id, r.claim_type, r.object_id): (r.n, r.confidence, r.first_id) for r in browse.repeated_groups(rows).collect()}
    assert groups == {("a", "T", "b"): (2, 0.8, "1"), (None, "T", "b"): (2, 0.3, "4")}
    key = ("subject_id", "claim_type", "object_id")
    assert sorted(ids(browse.first_of(rows, *key, order="claim_id", best=F.col("confidence")))) == ["1", "3", "4", "6"]
    assert browse.repeated(rows.limit(0)).count() == 0


def test_drawing(spark):
    rows = claims(spark)
    entities = spark.createDataFrame([("a", "A", "P", None), ("b", "B", None, ["x"]), ("c", None, "P", [])], "id string, canonical_name string, entity_type string, aliases array<string>")
    assert {r.entity_id: (r.degree, r.size) for r in browse.drawn_sizes(rows).collect() if r.entity_id} == {"a": (4, 20), "b": (5, 23)}
    many = spark.range(30).select(F.lit("q").alias("subject_id"), F.lit("q").alias("object_id"), F.col("id").cast("string").alias("claim_id"))
    assert [tuple(r) for r in browse.drawn_sizes(many).collect()] == [("q", 30, 32)]
    assert [(r.id, r.claim_count) for r in browse.top_entities(entities, rows, 5).collect()] == [("b", 5), ("a", 4), ("c", 0)]
    assert [(r.id, r.label, r.type, r.aliases) for r in browse.drawn_nodes(entities).collect()] == [("a", "A", "P", []), ("b", "B", None, ["x"]), ("c", None, "P", [])]
    assert tuple(browse.drawn_edges(rows).first()) == ("1", "a", "b", "T", 0.8, "T")
    assert ids(browse.list_entities(entities), "id") == ["c", "a", "b"] and ids(browse.list_entities(entities, "P", 1, 1), "id") == ["a"]
    assert ids(browse.entity_types(entities), "entity_type") == ["P"]


def test_mail(spark):
    mails = spark.createDataFrame(
        [("m1", "s", "x", None, None), ("m2", "s", "x", 5, "later"), ("m3", None, None, 3, " "), ("m4", None, None, 3, "first"), ("m5", "s", "y", 4, "z")],
        "message_id string, sender string, body string, date int, subject string",
    )
    kept, events = browse.exact_events(mails, "sender", "body")
    assert ids(kept, "message_id") == ["m1", "m3", "m5"] and kept.columns == mails.columns
    assert sorted(tuple(r) for r in events.collect()) == [("m2", "m1", 1.0), ("m4", "m3", 1.0)]
    assert tuple(browse.parse_stats(mails, "sender", "body").first()) == (5, 3, 2, 1)
    log = spark.createDataFrame([("m5", "v", "completed"), ("m3", "v", "failed"), ("m4", "w", "completed"), (None, "v", "completed")], "email_id string, extraction_version string, status string")
    assert ids(browse.queued(mails, log, "v"), "message_id") == ["m3", "m4", "m2", "m1"] and ids(browse.queued(mails, log, "v", 1), "message_id") == ["m3"]
    evidence = spark.createDataFrame([("c1", "m2"), ("c2", "m1"), ("c3", "gone"), ("c0", "m5")], "claim_id string, source_id string")
    assert [(r.claim_id, r.email_sender, r.email_subject, r.source_date) for r in browse.sourced(evidence, mails).collect()] == [("c0", "s", "z", 4), ("c1", "s", "later", 5), ("c2", "s", None, None), ("c3", None, None, None)]
    rows = mails.withColumn("thread_id", F.when(F.col("message_id") < "m5", "t")).withColumn("recipients", F.when(F.col("message_id") == "m2", F.array(F.lit("s"), F.lit("r"), F.lit(None))))
    assert {tuple(r) for r in browse.rollup(rows).collect()} == {("t", 4, 2, 3, 5, "first"), (None, 1, 1, 4, 4, "z")}
    assert tuple(browse.thread_stats(rows).first()) == (2, 2.5, 4)
    assert tuple(browse.thread_stats(rows.limit(0)).first()) == (0, None, None)
    bare = rows.select("thread_id", "message_id", "date")
    assert {(r.thread_id, r.participants, r.subject) for r in browse.rollup(bare).collect()} == {("t", 0, None), (None, 0, None)}


def test_counts(spark):
    rows = claims(spark)
    assert tuple(browse.stats({"x": rows, "y": rows.limit(0)}).first()) == (6, 0)
    assert [tuple(r) for r in browse.table_counts({"x": rows}).collect()] == [("x", 6)]
    with pytest.raises(ValueError):
        browse.table_counts({})
    assert sorted(tuple(r) for r in browse.type_counts(rows).collect()) == [("T", 5, 4, 0.5975), ("U", 1, 0, 0.49)]
    assert sorted(tuple(r) for r in browse.log_counts(rows, "claim_type", "subject_id", "who").collect()) == [("T", 5, 2), ("U", 1, 1)]
