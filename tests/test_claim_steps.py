"""Steps over whole tables of claims: how they are joined, however small the tables are, and what few ids spare."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from emberline.operators import folding, graph
from emberline.plans import graph_queries

from .helpers import SF, assert_same

NAMED = ["j2_named_claims", "t19_claim_text", "t19_claim_texts", "j16_named_ends"]
OTHERS = ["g12_timeline", "f10_permitted_claims", "a5_fold_events", "a5_claim_fold", "j4_evidence_map", "f18_broken_rules"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMED)
def test_claims_are_named_without_sorts(spark, name):
    """One join with orders and one an end; before, sort-merge joins above some size, and two more joins by name in J16."""
    made = plan(entry.queries()[name](spark, SF))
    over = made[: made.index("lineitem.parquet")]
    assert "SortMergeJoin" not in over and over.count("ShuffledHashJoin") == 3
    assert_same(spark, entry.queries()[name], entry.oracle_sql()[name])


@pytest.mark.parametrize("name", OTHERS)
def test_other_steps_hold_their_sql(spark, name):
    assert_same(spark, entry.queries()[name], entry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["a5_claim_fold", "a5_fold_events", "j4_evidence_map", "f18_broken_rules"])
def test_lines_are_hashed_with_orders(spark, name):
    """Orders are not broadcast where they are few, so the volume grows with the input."""
    made = plan(entry.queries()[name](spark, SF))
    assert made.count("ShuffledHashJoin [l_orderkey") == made.count("lineitem.parquet")
    assert made.count("lineitem.parquet") == {"a5_claim_fold": 1, "a5_fold_events": 1, "j4_evidence_map": 3, "f18_broken_rules": 5}[name]


def test_few_ids_are_a_filter_and_many_a_join(spark):
    claims = graph_queries.role(spark, SF, "claims")
    ids = claims.filter("source_id < 20").select("claim_id")
    n = ids.distinct().count()
    assert 2 < n <= graph.FEW and sorted(graph.few(ids.unionByName(ids.limit(1).select(F.lit(None).cast("string").alias("claim_id"))))) == sorted(r[0] for r in ids.distinct().collect())
    assert graph.few(ids, n) is not None and graph.few(ids, n - 1) is None
    few = graph.among(claims, "claim_id", ids)
    assert "LeftSemi" not in plan(few)
    many = graph.among(claims, "claim_id", claims.select("claim_id"))
    assert few.count() == n and many.count() == claims.count()


def test_few_entities_filter_the_claims_that_are_made(spark):
    claims = graph_queries.role(spark, SF, "claims")
    asked = spark.createDataFrame([("s:3",), ("c:7",), (None,)], "entity_id string")
    assert plan(graph.claims_at(claims, asked)).count(" IN (") + plan(graph.claims_at(claims, asked)).count(" INSET ") >= 2
    got = sorted((r.entity_id, r.claim_id) for r in graph.claims_at(claims, asked).collect())
    want = sorted((e, r.claim_id) for r in claims.collect() for e in ("s:3", "c:7") if e in (r.subject_id, r.object_id))
    assert got == want and got


def test_fold_events_pass_over_null_keys(spark):
    rows = [("a", "s", "T", "o", 0.5), ("b", "s", "T", "o", 0.9), ("c", "s", "T", "o", 0.9), ("d", None, "T", "o", 0.5), ("e", None, "T", "o", 0.9), ("f", "s", "T", "o", None)]
    df = spark.createDataFrame(rows, "claim_id string, subject_id string, claim_type string, object_id string, confidence double")
    df = df.selectExpr("*", "map('k', claim_id) AS properties", "date '2000-01-01' AS valid_from", "CAST(NULL AS date) AS valid_to", "array(1) AS evidence_ids", "claim_id AS seq")
    kept, events = folding.fold(df)
    into = {r.claim_id for r in kept.filter("subject_id = 's'").collect()}
    got = {(r.merged_from, r.merged_into) for r in events.collect()}
    assert len(into) == 1 and got == {(x, *into) for x in "abcf" if x not in into}


def test_the_line_of_a_message_is_made_once(spark):
    """Not once a keyword: F1 lower-cased every text 68 times."""
    made = entry.queries()["f1_signal_filter"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "lower(concat" in made and "contains(lower(concat" not in made
