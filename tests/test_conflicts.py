"""Counts of conflicts against all pairs, and a subject with very many claims."""

import datetime as dt
import random

from emberline.operators import conflicts
from pyspark.sql import functions as F

CLAIMS = "claim_id string, subject_id string, claim_type string, object_id string, valid_from timestamp, valid_to timestamp"


def test_counts_equal_all_pairs(spark):
    r, day = random.Random(3), dt.timedelta(days=1)
    at = lambda lo, hi: None if r.random() < 0.2 else dt.datetime(2001, 1, 1) + day * r.randrange(lo, hi)
    rows = [(f"k{i}", r.choice(["a", "b", None]), r.choice("xy"), r.choice("opq"), at(0, 200), at(150, 300)) for i in range(200)]
    low, high = dt.datetime.min, dt.datetime.max
    good = [(i, s, t, o, a or low, b or high) for i, s, t, o, a, b in rows if s and (a or low) <= (b or high)]
    want = {}
    for i, s, t, o, a, b in good:
        n = sum((s, t) == (s2, t2) and o != o2 and a <= b2 and a2 <= b for _, s2, t2, o2, a2, b2 in good)
        if n:
            want[i] = n
    counts = conflicts.conflict_counts(spark.createDataFrame(rows, CLAIMS)).persist()
    assert {x.claim_id: x.conflicts for x in counts.collect()} == want
    classes = conflicts.conflict_classes(counts).collect()
    assert sum(x.links for x in classes) == sum(want.values()) // 2 and sum(x.claims for x in classes) == len(want)
    assert conflicts.conflict_counts(spark.createDataFrame([], CLAIMS)).count() == 0


def test_a_subject_with_a_million_claims(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("claim_id"), F.lit("hot").alias("subject_id"), F.lit("t").alias("claim_type"), (F.col("id") % 2).cast("string").alias("object_id"), F.timestamp_seconds(F.col("id") * 60).alias("valid_from"), F.timestamp_seconds(F.col("id") * 60 + 60).alias("valid_to"))
    got = conflicts.conflict_counts(rows).groupBy("conflicts").count().collect()
    # each touches the claim before it and the one behind it, which have the other object
    assert {x.conflicts: x["count"] for x in got} == {1: 2, 2: n - 2}
