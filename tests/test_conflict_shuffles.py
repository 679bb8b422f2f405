"""Groups on both sides of the limit count alike, and small ones shuffle each claim once."""

import pytest
from emberline.operators import conflicts
from pyspark.sql import functions as F

from tests.test_setjoin import shuffled


@pytest.mark.parametrize("hot", [0, 40, 1 << 16])
def test_sizes_of_groups_make_no_difference(spark, monkeypatch, hot):
    monkeypatch.setattr(conflicts, "HOT", hot)
    n = 600
    k = F.pmod(F.xxhash64("id"), F.lit(90)).cast("int")
    subject = F.when(F.col("id") < 500, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    day = lambda d: F.date_add(F.lit("2001-01-01").cast("date"), d)
    rows = spark.range(n).select(F.col("id").cast("string").alias("claim_id"), subject.alias("subject_id"), F.lit("t").alias("claim_type"), (F.col("id") % 3).cast("string").alias("object_id"), day(k).alias("valid_from"), F.when(F.col("id") % 5 > 0, day(k + 4)).alias("valid_to"))
    rows = rows.persist()
    a, b = rows.alias("a"), rows.alias("b")
    meet = F.expr("a.subject_id = b.subject_id AND a.object_id != b.object_id AND (b.valid_to IS NULL OR a.valid_from <= b.valid_to) AND (a.valid_to IS NULL OR b.valid_from <= a.valid_to)")
    want = {x[0]: x[1] for x in a.join(b, meet).groupBy("a.claim_id").count().collect()}
    assert {x.claim_id: x.conflicts for x in conflicts.conflict_counts(rows).collect()} == want
    rows.unpersist()


def test_small_groups_shuffle_a_claim_once(spark, tmp_path):
    n = 40_000
    key = lambda c: F.sha2(c.cast("string"), 256)
    rows = spark.range(n).select(key(F.col("id")).alias("claim_id"), (F.col("id") % 4000).cast("string").alias("subject_id"), F.lit("t").alias("claim_type"), F.col("id").cast("string").alias("object_id"), F.timestamp_seconds("id").alias("valid_from"), F.timestamp_seconds(F.col("id") + 9000).alias("valid_to"))
    rows.write.parquet(str(tmp_path / "c"))
    before = shuffled(spark)
    assert conflicts.conflict_counts(spark.read.parquet(str(tmp_path / "c"))).count() == n
    assert shuffled(spark) - before < n * 2 * 64
