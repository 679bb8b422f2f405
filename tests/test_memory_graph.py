"""Linking, expansion, packs, resolution, validation and sinks against fixtures and brute force."""

import datetime as dt
import itertools
import json
import time

import pytest
from emberline.functions import embed, names
from emberline.operators import extraction, folding, graph, resolution, retrieval, sinks, validation
from pyspark.sql import functions as F

ENTITY = "id string, canonical_name string, entity_type string, aliases array<string>, properties map<string,string>"
CLAIM = "claim_id string, subject_id string, object_id string, claim_type string, confidence double, is_current boolean, valid_from date, valid_to date"
DAY = dt.date(2002, 1, 14)


def entities(spark, *rows):
    return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], ENTITY)


def resolved(spark, *rows, threshold=0.82):
    kept, events = resolution.resolve(entities(spark, *rows), threshold)
    return {r.id: r for r in kept.collect()}, events.collect()


def test_resolution(spark):
    kept, events = resolved(spark, ("e1", "Kenneth Lay", "Person", ["ken.lay@x.com"], {"role": "ceo"}), ("e2", "Ken Lay", "Person", ["Ken", "KEN.LAY@x.com"], {"role": "boss", "city": "h"}))
    assert set(kept) == {"e1"} and events[0].reason == "email_address_match:ken.lay@x.com" and events[0].confidence == 0.95
    assert kept["e1"].aliases == ["KEN.LAY@x.com", "Ken", "Ken Lay", "ken.lay@x.com"] and kept["e1"].properties == {"role": "ceo", "city": "h"}
    kept, events = resolved(spark, ("e1", "Kenneth Lay", "Person"), ("e2", "Ken Lay", "Person"), threshold=0.75)
    assert set(kept) == {"e1"} and events[0].reason == "fuzzy_name_0.88"
    assert len(resolved(spark, ("e1", "Kenneth Lay", "Person"), ("e2", "Jeff Skilling", "Person"))[0]) == 2
    assert len(resolved(spark, ("e1", "Enron Corp", "Organization"), ("e2", "Enron Trading", "Organization"))[0]) == 2
    assert len(resolved(spark, ("e1", "Enron", "Topic"), ("e2", "Enron", "Topic"))[0]) == 2
    # addresses tie a chain, whatever the types; the mapping follows survivors that went later
    kept, events = resolved(spark, ("a", "Al", "Person", ["x@y.z"]), ("b", "Bobby", "Topic", ["x@y.z", "q@y.z"]), ("c", "Carlotta", "Person", ["q@y.z"]))
    assert set(kept) == {"c"} and {r.source_id: r.canonical_id for r in resolution.mapping(spark.createDataFrame(events)).collect()} == {"a": "c", "b": "c"}
    assert resolved(spark)[0] == {}


def test_similar_pairs_equal_brute_force(spark):
    first, last = ["Kenneth", "Ken", "Jeff", "Jeffrey", "Maria"], ["Lay", "Lane", "Skilling", "Skiling", "Lopez"]
    rows = [(f"p{i:02}", f"{f} {la}", "Person", [f"{la}, {f}"] if i % 4 == 0 else []) for i, (f, la) in enumerate(itertools.product(first, last))]
    want = {}
    for a, b in itertools.combinations(rows, 2):
        s = max([names.similarity(a[1], b[1]), *(names.similarity(a[1], x) for x in b[3]), *(names.similarity(x, b[1]) for x in a[3])])
        if s >= 0.82:
            want[a[0], b[0]] = round(s, 9)
    assert len(want) > 5
    assert {(r.a, r.b): round(r.sim, 9) for r in resolution.similar_pairs(resolution._plain(entities(spark, *rows))).collect()} == want
    # the greedy pass, one pair after the other
    alive, events = {r[0]: r[1] for r in rows}, []
    for (a, b), s in sorted(want.items(), key=lambda x: (-x[1], x[0])):
        if a in alive and b in alive:
            goes, stays = (b, a) if len(alive[a]) >= len(alive[b]) else (a, b)
            del alive[goes]
            events.append((goes, stays))
    kept, found = resolution.merge_by_name(entities(spark, *rows))
    assert {(r.merged_from, r.merged_into) for r in found.collect()} == set(events) and len(events) > 3
    assert {r.id for r in kept.collect()} == set(alive)


ANSWER = {
    "entities": [{"name": "  LAY,   KENNETH ", "type": "Person", "aliases": ["Ken", "ken", "Ken"]}, {"name": "Acme  Corp", "type": "Organization"}],
    "claims": [
        {"type": "WORKS_AT", "subject": "lay, kenneth", "object": "Acme Corp", "evidence_excerpt": "Ken works at Acme", "confidence": 0.9},
        {"type": "MENTIONS", "subject": "Ken", "object": "Acme Corp", "evidence_excerpt": "never said so at all", "confidence": 0.9},
        {"type": "MENTIONS", "subject": "Ken", "object": "Acme Corp", "evidence_excerpt": "Ken works", "confidence": 0.1},
        {"type": "MENTIONS", "subject": "Ken", "object": "Nobody", "evidence_excerpt": "Ken works", "confidence": 0.9},
    ],
}
BODY = "Dear all,\n Ken works at Acme these days."


def test_validation(spark):
    bad = json.loads(json.dumps(ANSWER))
    bad["claims"][0]["confidence"] = 1.5
    rows = [
        (1, f"```json\n{json.dumps(ANSWER)}\n```", BODY), (2, "not json at all", BODY), (3, f"Sure! {json.dumps(bad)} Bye", BODY), (4, None, None),
        (5, json.dumps(ANSWER | {"claims": ANSWER["claims"][:1]}), "Ken\n\tworks   at Acme"), (6, '{"entities": 3}', BODY), (7, json.dumps(ANSWER | {"claims": ANSWER["claims"][:1]}), "it is Ken work at Acme now"),
    ]
    found = {r.message_id: r for r in validation.validated(spark.createDataFrame(rows, "message_id int, raw_response string, body string")).collect()}
    one = found[1]
    assert one.is_valid and [(e.name, e.aliases) for e in one.entities] == [("Kenneth Lay", ["Ken"]), ("Acme Corp", [])]
    assert [(c.type, c.subject, c.object, c.start, c.end) for c in one.claims] == [("WORKS_AT", "Kenneth Lay", "Acme Corp", 11, 28)]
    assert [(e.action, e.reason) for e in one.events] == [("repaired", "name_normalized"), ("passed", "validated"), ("dropped", "evidence_not_found"), ("dropped", "below_confidence_threshold")]
    assert not found[2].is_valid and found[2].events[0].reason == "json_parse_failure" and not found[4].is_valid and not found[6].is_valid
    assert found[3].is_valid and not found[3].claims and found[3].events[0].reason == "schema_validation_failure"
    assert found[5].claims[0].start is None and len(found[7].claims) == 1
    counts = {r.message_id: (r.dropped, r.repaired, r.passed) for r in validation.validation_counts(validation.validated(spark.createDataFrame(rows[:1], "message_id int, raw_response string, body string"))).collect()}
    assert counts == {1: (2, 1, 1)}
    names = spark.createDataFrame([("LAY, KENNETH",), ("o'neil  smith-jones ",), ("",), ("a,b, c",), ("émile 2nd",)], "n string").select(validation.person_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["Kenneth Lay", "O'Neil Smith-Jones", "", "B, C A", "Émile 2Nd"]
    tag = extraction.version_tag("m", "system", [{"b": 1, "a": 2}])
    assert tag == extraction.version_tag("m", "system", [{"a": 2, "b": 1}]) and len(tag) == len("v1.0_m_") + 12
    dates = spark.createDataFrame([("2002-01-14T08:00:00Z",), ("never",)], "s string").select(validation.iso_date(F.col("s"))).collect()
    assert dates[0][0] is not None and dates[1][0] is None


def test_extraction(spark):
    mails = [("m1", "ann", [f"r{i}" for i in range(12)], "2002", "hi", "Kenneth Lay met Jeff Skilling."), ("m2", "ann", None, None, None, "boom"), ("m3", None, [], None, None, None)]
    df = spark.createDataFrame(mails, "message_id string, sender string, recipients array<string>, date string, subject string, body string")
    prompt = df.select(extraction.user_prompt(df)).first()[0]
    assert prompt.startswith("METADATA:\nFrom: ann\nTo: r0, ") and "r9\nDate: 2002\nSubject: hi\n\nBODY:\nKenneth" in prompt and "r10" not in prompt

    def model(text):
        if "boom" in text:
            raise ValueError("no")
        return extraction.by_rules(text)

    found = {r.message_id: r for r in extraction.extract(df, model).collect()}
    assert found["m1"].is_valid and len(found["m1"].claims) == 2 and found["m1"].attempts == 1
    assert not found["m2"].is_valid and found["m2"].attempts == 3 and "no" in found["m2"].error and found["m3"].is_valid
    again = {r.message_id: r for r in extraction.extract(df, model, fallback=extraction.by_rules).collect()}
    assert again["m2"].is_valid and again["m2"].attempts == 4
    stats = extraction.extraction_stats(extraction.extract(df, model)).first()
    assert (stats.total_emails, stats.successful, stats.failed, stats.success_rate, stats.total_claims) == (3, 2, 1, 0.667, 2)


def test_schema_item_by_item(spark):
    good = {"name": "Ann Lee", "type": "Person"}
    bad = [{"name": "", "type": "Person"}, {"name": "x" * 501, "type": "Topic"}, {"name": "A", "type": "Alien"}, {"name": 3, "type": "Topic"}, {"name": "A", "type": "Topic", "aliases": "no"}, {"name": "A", "type": "Topic", "aliases": [1]}, {"name": "A", "type": "Topic", "properties": []}, 7, None]
    claim = {"type": "MENTIONS", "subject": "ann lee", "object": "ANN LEE", "evidence_excerpt": "lee", "confidence": "0.5", "properties": {"n": 1, "s": "x"}}
    wrong = [claim | x for x in ({"confidence": True}, {"confidence": None}, {"confidence": -0.1}, {"confidence": "high"}, {"subject": ""}, {"evidence_excerpt": None}, {"type": "LIKES"}, {"properties": "no"})]
    rows = [(1, {"entities": [good, *bad], "claims": [claim, *wrong]}), (2, {"entities": [good]}), (3, []), (4, {"entities": [good], "claims": {}}), (5, {"entities": bad}), (6, {})]
    answers = spark.createDataFrame([(i, json.dumps(x), "ann lee") for i, x in rows], "message_id int, raw_response string, body string")
    got = {r.message_id: r for r in validation.validated(answers).collect()}
    one = got[1]
    assert [e.name for e in one.entities] == ["Ann Lee"] and len(one.claims) == 1 and one.claims[0].confidence == 0.5 and one.claims[0].properties == {"n": "1", "s": "x"}
    assert [e.reason for e in one.events] == ["schema_validation_failure"] + ["partial_recovery_failed"] * 17 + ["validated"]
    assert [e.target for e in one.events][1:-1] == ["entity"] * 9 + ["claim"] * 8
    assert got[2].is_valid and not got[2].events and got[4].is_valid and [e.reason for e in got[4].events] == ["schema_validation_failure"]
    assert not got[3].is_valid and not got[5].is_valid and not got[6].is_valid and not got[6].events
    assert validation.validated(answers.limit(0)).count() == 0


def test_calls_run_at_once_and_fail_alone(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(60)], "message_id int, prompt string").coalesce(1)

    def model(text):
        if text == "p7":
            raise ValueError("broken")
        time.sleep(2.0 if text == "p9" else 0.05)
        return text.upper()

    def timed(**how):
        start = time.perf_counter()
        rows = extraction.asked(prompts, model, **how).collect()
        return rows, time.perf_counter() - start

    timed(concurrency=60, per_minute=None)
    rows, fast = timed(concurrency=20, per_minute=None, seconds=0.5)
    assert [r.message_id for r in rows] == list(range(60)) and [r.message_id for r in rows if r.error] == [7, 9]
    assert rows[8].raw_response == "P8" and "broken" in rows[7].error and rows[9].error.startswith("TimeoutError")
    _, slow = timed(concurrency=1, per_minute=None, seconds=0.5)
    assert fast < slow - 1.5
    _, paced = timed(concurrency=60, per_minute=1800)
    assert paced >= 59 / 30


def small_graph(spark):
    e = entities(spark, ("p1", "Jeff Skilling", "Person", ["jeff"]), ("p2", "Kenneth Lay", "Person"), ("o1", "Enron Corp", "Organization"), ("o2", "Acme Corp", "Organization"), ("z", "Far Away", "Topic"))
    rows = [("a", "p1", "o1", "WORKS_AT", 0.9, True, DAY, None), ("b", "p1", "o2", "WORKS_AT", 0.8, True, DAY, None), ("c", "p2", "o1", "WORKS_AT", 0.7, True, None, None), ("d", "o1", "z", "DISCUSSES", 0.6, True, DAY, DAY)]
    rows += [("e", "p1", "p2", "REPORTS_TO", 0.2, True, DAY, None), ("f", "p1", "p2", "REPORTS_TO", 0.9, False, DAY, None)]
    evidence = spark.createDataFrame([("a", "s1", DAY), ("a", "s2", None), ("d", "s1", DAY)], "claim_id string, source_id string, source_date date")
    return e, spark.createDataFrame(rows, CLAIM), evidence


def test_answer(spark):
    e, c, ev = small_graph(spark)
    asked = spark.createDataFrame([(1, "Where does Jeff Skilling work?"), (2, "what about enron these days"), (3, None), (4, "Is Jeff here?")], "question_id int, question string")
    links = {(r.question_id, r.id): r.link_source for r in retrieval.link_entities(asked, e).collect()}
    assert links[1, "p1"] == "keyword_exact" and links[2, "o1"] == "fallback_fuzzy" and links[4, "p1"] == "keyword_exact" and not any(q == 3 for q, _ in links)
    near = retrieval.link_entities(asked, e, embed.embedded(e, "id", "canonical_name")).collect()
    assert {r.id for r in near if r.question_id == 3} == {"p1", "p2", "o1", "o2", "z"}
    packs = {r.question_id: r for r in retrieval.answer(asked, e, c, ev).collect()}
    one = packs[1]
    assert [x.claim_id for x in one.claims][:2] == ["a", "b"] and one.total_evidence_count == sum(len(x.evidence) for x in one.claims) == 2
    assert [(x.a_id, x.b_id) for x in one.conflicts] == [("a", "b")] and "'Jeff Skilling' has conflicting 'WORKS_AT'" in one.conflicts[0].reason
    assert [x.source_id for x in one.claims[0].evidence] == ["s2", "s1"] and packs[3].claims == [] == packs[3].entities
    access = spark.createDataFrame([("s1", "u")], "source_id string, user_id string")
    allowed = {r.question_id: r for r in retrieval.answer(asked, e, c, ev, access=access, user="u").collect()}
    assert [x.claim_id for x in allowed[1].claims] == ["a"] and allowed[1].total_evidence_count == 1
    assert retrieval.answer(asked.limit(0), e, c, ev).count() == 0


def test_expansion_meets_each_claim_once(spark):
    e, c, _ = small_graph(spark)
    nodes, edges = graph.expand(c, spark.createDataFrame([(1, "p1")], "question_id int, entity_id string"), depth=3)
    assert {r.claim_id: r.hop for r in edges.collect()} == {"a": 1, "b": 1, "c": 2, "d": 2}
    assert {r.entity_id: r.hop for r in nodes.collect()} == {"p1": 0, "o1": 1, "o2": 1, "p2": 2, "z": 2}
    with pytest.raises(ValueError):
        graph.expand(c, nodes, depth=4)
    n, g = graph.graph(c, e, top=1)
    assert {r.id for r in g.collect()} == {"a", "b"} and n.count() == 3


def test_fold(spark):
    rows = [("c1", "e1", "WORKS_AT", "e2", {"r": "1"}, 0.9, DAY, None, ["v1"], 1), ("c2", "e1", "WORKS_AT", "e2", {"r": "2"}, 0.9, DAY - dt.timedelta(1), DAY, ["v2"], 2), ("c3", "e1", "REPORTS_TO", "e3", None, 0.5, None, None, None, 3)]
    df = spark.createDataFrame(rows, "claim_id string, subject_id string, claim_type string, object_id string, properties map<string,string>, confidence double, valid_from date, valid_to date, evidence_ids array<string>, seq int")
    kept, events = folding.fold(df)
    got = {r.claim_id: r for r in kept.collect()}
    assert set(got) == {"c1", "c3"} and got["c1"].evidence_ids == ["v1", "v2"] and got["c1"].valid_from == DAY - dt.timedelta(1) and got["c1"].valid_to == DAY and got["c1"].properties == {"r": "1"}
    assert [tuple(r) for r in events.collect()] == [("c2", "c1", "same_semantic_key:('e1', 'WORKS_AT', 'e2')")]
    after = folding.superseded(df.withColumn("is_current", F.lit(True)), events, DAY)
    assert {r.claim_id: (r.is_current, r.valid_to) for r in after.collect()} == {"c1": (True, None), "c2": (False, DAY), "c3": (True, None)}


def test_sinks_may_run_again(spark, tmp_path):
    base = str(tmp_path)
    mails = spark.createDataFrame([("m1", 1), ("m2", 2)], "message_id string, at int")
    for _ in range(2):
        sinks.insert_ignore(base, "emails", mails, ["message_id"], "at")
        sinks.append_once(base, "evidence", spark.createDataFrame([("v1", "x"), ("v1", "x")], "id string, t string"), "id")
    assert sinks.read(spark, base, "emails").count() == 2 and sinks.read(spark, base, "evidence").count() == 1
    log = "email_id string, extraction_version string, status string, processed_at int"
    for status, at in (("processing", 1), ("completed", 2)):
        sinks.log_status(base, spark.createDataFrame([("m1", "v", status, at)], log))
    assert [r.status for r in sinks.read(spark, base, "processing_log").collect()] == ["completed"]
    people = "id string, canonical_name string, entity_type string, created_at int, updated_at int"
    sinks.upsert_entities(base, spark.createDataFrame([("e1", "Ann Lee", "Person", 1, 1)], people))
    sinks.upsert_entities(base, spark.createDataFrame([("e9", "ANN LEE", "Person", 2, 2), ("e3", "Ann Lee", "Topic", 2, 2)], people))
    assert {(r.id, r.canonical_name, r.created_at) for r in sinks.read(spark, base, "entities").collect()} == {("e1", "ANN LEE", 1), ("e3", "Ann Lee", 2)}
    for text in ("old", "new"):
        sinks.store_embeddings(base, spark.createDataFrame([("e1", text)], "id string, text string"), lambda df: embed.embedded(df, "id", "text"))
    stored = sinks.read(spark, base, "embeddings").collect()
    assert len(stored) == 1 and stored[0].embedding == pytest.approx(embed.hashed(["new"])[0].tolist())
    sinks.rewrite(base, "merge_events", spark.createDataFrame([("x", None, None)], "id string, reversed_at int, reversed_reason string"))
    sinks.reverse_merges(base, spark.createDataFrame([("x", 7, "wrong")], "id string, at int, reason string"))
    assert [tuple(r) for r in sinks.read(spark, base, "merge_events").collect()] == [("x", 7, "wrong")]
    sinks.truncate(spark, base)
    assert sinks.read(spark, base, "emails").count() == 0 == sinks.read(spark, base, "entities").count()
    e, c, ev = small_graph(spark)
    stats = folding.export_stats(e, c.withColumn("pending_review", F.lit(False)), ev)
    sinks.export_graph(f"{base}/out", e, c, ev, stats, min_confidence=0.5, include_historical=False)
    assert spark.read.json(f"{base}/out/edges").count() == 4 and spark.read.json(f"{base}/out/stats").first().node_count == 5
    sinks.export_packs(f"{base}/packs", retrieval.answer(spark.createDataFrame([(1, "Where is Jeff Skilling?")], "question_id int, question string"), e, c, ev))
    assert spark.read.json(f"{base}/packs/index").first().claims >= 2


def test_embedding_is_of_length_one():
    v = embed.hashed(["Kenneth Lay", "kenneth  lay", "", "Other"])
    assert (v[0] == v[1]).all() and abs(float((v[0] ** 2).sum()) - 1) < 1e-5 and not v[2].any() and float(v[0] @ v[3]) < 0.5
