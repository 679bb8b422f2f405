"""Planted violations of each kind."""

from emberline.operators import constraints


def test_planted_violations(spark):
    entities = spark.createDataFrame([("e1", "A", "Person"), ("e2", "B", "Alien"), ("e2", "C", "Topic"), (None, None, "Topic")], "id string, canonical_name string, entity_type string")
    got = sorted((r.id or "", r.broken) for r in constraints.broken(entities, constraints.checks("entities"), ["id"]).collect())
    assert got == [("", ["canonical_name_missing", "id_missing"]), ("e1", []), ("e2", ["entity_type_unknown", "key_repeated"]), ("e2", ["key_repeated"])]
    rows = [("k1", "e1", "e2", "MENTIONS", 0.5, 1, 2), ("k2", "e1", "zz", "LIKES", 1.5, 3, 2), ("k3", None, "e1", "DECIDED", None, None, 2), ("k4", "e1", "e1", None, -0.1, 1, 1)]
    claims = spark.createDataFrame(rows, "claim_id string, subject_id string, object_id string, claim_type string, confidence double, valid_from int, valid_to int")
    refs = {"subject_id": (entities, "id"), "object_id": (entities, "id")}
    checked = constraints.broken(claims, constraints.checks("claims"), ["claim_id"], refs)
    assert {r.claim_id: r.broken for r in checked.collect()} == {"k1": [], "k2": ["claim_type_unknown", "confidence_outside", "object_id_unknown", "window_reversed"], "k3": ["subject_id_missing"], "k4": ["confidence_outside"]}
    good, bad = constraints.split(checked)
    assert [r.claim_id for r in good.collect()] == ["k1"] and good.columns == claims.columns and bad.count() == 3
    log = spark.createDataFrame([("m", "v", "done"), ("m", "v", "failed")], "email_id string, extraction_version string, status string")
    assert sorted(r.broken for r in constraints.broken(log, constraints.checks("processing_log"), ["email_id", "extraction_version"]).collect()) == [["key_repeated"], ["key_repeated", "status_unknown"]]
    merges = spark.createDataFrame([("m1", "t", "entity_merge"), ("m2", None, "other")], "id string, target_id string, action_type string")
    assert [r.broken for r in constraints.broken(merges, constraints.checks("merge_events")).orderBy("id").collect()] == [[], ["action_unknown", "target_id_missing"]]
    evidence = spark.createDataFrame([("k1", "s"), ("k9", None)], "claim_id string, source_id string")
    got = constraints.broken(evidence, constraints.checks("evidence"), references={"claim_id": (claims, "claim_id")}).orderBy("claim_id").collect()
    assert [r.broken for r in got] == [[], ["claim_id_unknown", "source_id_missing"]]
    assert constraints.broken(claims.limit(0), constraints.checks("claims"), ["claim_id"], refs).count() == 0
