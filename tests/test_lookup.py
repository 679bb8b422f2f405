"""Lookups, texts and deduplication statistics against fixtures and brute force."""

import itertools

from emberline.functions.names import similarity
from emberline.operators import lookup, neardup
from emberline.plans import lookup_queries
from pyspark.sql import functions as F

from tests.helpers import SF

ENTITIES = "id string, canonical_name string, entity_type string, aliases array<string>, properties map<string,string>"


def entities(spark):
    rows = [
        ("e1", "Ann", "Person", ["A.", "Bob", None], {"title": "t", "role": "r", "other": "o", "department": None}),
        ("e2", "Bob", "Topic", None, None),
        ("e3", "bob", "Person", [], {}),
        ("e4", None, None, ["Ann", "Ann"], {"description": "d"}),
    ]
    return spark.createDataFrame(rows, ENTITIES)


def test_by_name(spark):
    rows = entities(spark)
    asked = spark.createDataFrame([("Ann",), ("Bob",), ("Bob",), ("none",), (None,)], "name string")
    assert sorted((r.name, r.id) for r in lookup.by_name(rows, asked).collect()) == [("Ann", "e1"), ("Ann", "e4"), ("Bob", "e1"), ("Bob", "e2")]
    typed = spark.createDataFrame([("Bob", "Topic"), ("Ann", "Person"), ("Ann", None), ("bob", "Topic")], "name string, entity_type string")
    found = lookup.by_name(rows, typed)
    assert found.columns == ["name", *rows.columns]
    assert sorted((r.name, r.id) for r in found.collect()) == [("Ann", "e1"), ("Ann", "e4"), ("Bob", "e2")]
    assert lookup.by_name(rows, asked.limit(0)).count() == 0 and lookup.by_name(rows.limit(0), asked).count() == 0


def test_by_id_and_search(spark):
    rows = entities(spark)
    assert [r.id for r in lookup.by_id(rows, spark.createDataFrame([("e2",), ("e2",), (None,)], "id string")).collect()] == ["e2"]
    ids = lambda *a: [r.id for r in lookup.search(rows, *a).collect()]
    assert ids("BO") == ["e1", "e2", "e3"] and ids("bo", ["Topic"]) == ["e2"] and ids("%") == [] and ids(" ") == ["e4", "e1", "e2", "e3"] and ids("ann") == ["e4", "e1"]


def test_texts(spark):
    rows = entities(spark)
    got = [r.text for r in rows.select("id", lookup.entity_text(rows).alias("text")).orderBy("id").collect()]
    assert got == ["Ann (Person) also known as: A., Bob role: r title: t", "Bob (Topic)", "bob (Person)", " () also known as: Ann, Ann description: d"]
    claims = spark.createDataFrame([("Ann", "KNOWS", None, {"b": "1", "a": None, "c": "2"}), ("x", "T", "y", None)], "subject_name string, claim_type string, object_name string, properties map<string,string>")
    assert sorted(r[0] for r in claims.select(lookup.claim_text(claims)).collect()) == ["Ann KNOWS  b: 1 c: 2", "x T y"]


def _one_pass(rows, least=0.85):
    """Exact by source and text, then leaders in order: (date, nulls first, doc_id)."""
    grams = lambda t: {t.strip().lower()[i : i + 5] for i in range(max(1, len(t.strip()) - 4))}
    first = {}
    for d, s, t, at in sorted(rows, key=lambda r: (r[3] or "", r[0])):
        first.setdefault((s, t), (d, t))
    leaders, node = [], {}
    stays = 0
    for _, t in first.values():
        if t not in node:
            near = any(len(grams(t) & grams(x)) >= least * len(grams(t) | grams(x)) for x in leaders)
            node[t] = near
            if not near:
                leaders.append(t)
                stays += 1
    return [len(rows), len(first), stays, len(rows) - len(first), len(first) - stays]


def test_dedup_outcome(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank while rain falls on the quiet town"
    texts = [base, base + "s", base[:-9] + "old town", base.replace("quick", "slow"), "another text that is quite different from all the rest of them", "", "abc"]
    rows = [(i, f"s{i % 2}", t, d) for i, (t, d) in enumerate(itertools.product(texts, ["2001-01-02", None, "2000-05-05"]))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = neardup.dedup_outcome(docs, F.concat_ws("|", "source", "text"), order="at").first()
    assert list(got) == _one_pass(rows)
    plain = neardup.dedup_outcome(docs, F.concat_ws("|", "source", "text")).first()
    assert list(plain) == _one_pass([(d, s, t, None) for d, s, t, _ in rows])
    assert list(neardup.dedup_outcome(docs.limit(0), F.col("text")).first()) == [0] * 5


def test_the_first_date_leads(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank while rain falls"
    docs = spark.createDataFrame([(1, base, "2002-01-01"), (2, base + "s", "2001-01-01"), (3, base + "t", None)], "doc_id long, text string, at string")
    assert {r.canonical_id for r in neardup.near_dedup(docs, order="at").collect()} == {3}
    assert {r.canonical_id for r in neardup.near_dedup(docs).collect()} == {1}


def test_extraction_outcome(spark, tmp_path):
    rows = [(1, 0, "user", "Ann Lee met Bob Ray."), (1, 1, "user", "nothing here"), (2, 0, None, None), (3, None, "x", "lost")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = lookup_queries.extraction_outcome(spark, str(tmp_path)).first().asDict()
    assert (got["total_emails"], got["successful"], got["failed"], got["total_claims"], got["total_entities"]) == (3, 3, 0, 2, 5)


def test_name_pairs_equal_all_pairs(spark):
    """The registered query, on the parts of the smallest tables."""
    parts = sorted(("p:" + str(r.p_partkey), r.p_name) for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name").collect())
    first = {}
    for a, x in parts:
        first.setdefault(x, a)
    want = {("member", first[x], a): 1.0 for a, x in parts}
    for (x, a), (y, b) in itertools.combinations(first.items(), 2):
        if (s := round(similarity(x, y), 6)) >= 0.82:
            want["pair", min(a, b), max(a, b)] = s
    assert {(r.kind, r.a, r.b): r.sim for r in lookup_queries.name_pairs(spark, SF).collect()} == want
