"""Names, near-duplicates, threads, writes, mail folders and streams against brute force and fixtures."""

import datetime as dt
import itertools
import random

import pytest
from emberline.functions import names
from emberline.operators import mail, neardup, threads, writes
from emberline.sources.maildir import read_maildir
from emberline.streaming import ingest
from pyspark.sql import functions as F


def test_names(spark):
    q = spark.createDataFrame([("Who did Kenneth Lay hire at Acme? Lay", ["a", "A ", "", "x@Y.org and z@y.org"], "Lay, Kenneth"), (None, None, None)], "q string, al array<string>, n string")
    got = q.select(names.candidate_names(F.col("q")), names.clean_aliases(F.col("al")), names.email_addresses(F.col("al")), names.name_parts(F.col("n"))).collect()
    assert got[0][0] == ["Kenneth Lay", "Kenneth", "Lay", "Acme"]
    assert got[0][1] == ["a", "x@Y.org and z@y.org"] and got[0][2] == ["x@y.org"] and tuple(got[0][3]) == ("kenneth", "lay")
    assert got[1][0] == []
    assert round(names.similarity("Kenneth Lay", "Ken Lay"), 4) == 0.8811
    assert round(names.similarity("Lay, Kenneth", "Kenneth Lay"), 4) == 0.8135
    assert round(names.similarity("Kenneth Lay", "Jeff Skilling"), 4) == 0.2091
    assert round(names.similarity("Enron", "Enron"), 2) == 0.67
    assert spark.createDataFrame([("Ann Lee", "Ann Lee"), (None, "x")], "a string, b string").select(names.name_similarity("a", "b")).collect()[0][0] == pytest.approx(0.97)
    assert names.partial_ratio("lay", "kenneth lay said") == 1.0


def _brute_pairs(docs, t):
    sh = {}
    for i, x in docs:
        x = (x or "").lower().strip()
        sh.setdefault(x if len(x) < 5 else (x, docs and dict(docs)[i]), []).append(i)
    texts = {}
    for i, x in docs:
        texts[x or ""] = min(i, texts.get(x or "", i))
    sets = {i: {s[k : k + 5] for k in range(max(len(s) - 4, 1))} for x, i in texts.items() for s in [x.lower().strip()]}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde ") for _ in range(90)) for _ in range(8)]
    docs = [(k, "".join(c if rng.random() > 0.012 else rng.choice("xyz") for c in rng.choice(base))) for k in range(120)]
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, None), (203, ""), (204, "ab")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = _brute_pairs(docs, 0.85)
    assert len(want) > 20
    assert {(r.a, r.b) for r in neardup.near_pairs(df).collect()} == want
    lead = {}
    nodes = {}
    for i, x in docs:
        nodes[x or ""] = min(i, nodes.get(x or "", i))
    for n in sorted(nodes.values()):
        if n not in lead:
            lead[n] = n
            for a, b in want:
                if a == n:
                    lead.setdefault(b, n)
    got = {r.doc_id: r.canonical_id for r in neardup.near_dedup(df).collect()}
    assert got == {i: lead[nodes[x or ""]] for i, x in docs}
    assert neardup.near_dedup(df.limit(0)).collect() == []


def test_threads(spark):
    day = dt.datetime(2002, 1, 14)
    rng = random.Random(2)
    mails = [(f"m{k:02}", None, [], rng.choice("ab"), [rng.choice("abcd")], rng.choice(["Plan", "Re: plan", "Budget"]), day + dt.timedelta(days=rng.randrange(60))) for k in range(40)]
    mails += [("r1", "m00", [], "z", ["y"], "", None), ("r2", "gone", ["r1"], None, None, None, None)]
    df = spark.createDataFrame(mails, "message_id string, in_reply_to string, references array<string>, sender string, recipients array<string>, subject string, date timestamp")
    root = {m[0]: m[0] for m in mails}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def union(x, y):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)

    for m in mails:
        for to in [m[1], *m[2]]:
            if to in root:
                union(m[0], to)
    for a, b in itertools.combinations(mails[:40], 2):
        p, q = {a[3], *a[4]}, {b[3], *b[4]}
        if a[5].lower().removeprefix("re: ") == b[5].lower().removeprefix("re: ") and abs(a[6] - b[6]) <= dt.timedelta(days=7) and len(p & q) / len(p | q) >= 0.3:
            union(a[0], b[0])
    assert {r[0]: r[1] for r in threads.build_threads(df).collect()} == {m: find(m) for m in root}


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 0)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 2), (2, "d", 3)], "id int, v string, at int")
    assert sorted(map(tuple, writes.insert_ignore(old, new, ["id"], "at").collect())) == [(1, "a", 0), (2, "c", 2)]
    assert sorted(map(tuple, writes.upsert(old, new, ["id"], "at").collect())) == [(1, "b", 1), (2, "d", 3)]
    assert sorted(map(tuple, writes.upsert(old, new, ["id"], "at", keep=("v",)).collect())) == [(1, "a", 1), (2, "c", 3)]
    mapping = spark.createDataFrame([("x", "y")], "source_id string, canonical_id string")
    rows = spark.createDataFrame([("x", "q"), (None, "x")], "s string, o string")
    assert {tuple(r) for r in writes.repoint(rows, mapping, "s", "o").collect()} == {("y", "q"), (None, "y")}
    log = spark.createDataFrame([("1", "v", "completed"), ("2", "v", "failed")], "email_id string, extraction_version string, status string")
    assert [r[0] for r in writes.unprocessed(spark.createDataFrame([("1",), ("2",)], "message_id string"), log, "v").collect()] == ["2"]
    events = spark.createDataFrame([("e", None, None), ("f", None, None)], "id string, reversed_at int, reversed_reason string")
    done = writes.reversed_merges(events, spark.createDataFrame([("e", 5, "wrong"), ("e", 6, "late")], "id string, at int, reason string"))
    assert {tuple(r) for r in done.collect()} == {("e", 5, "wrong"), ("f", None, None)}


def test_signal_filter(spark):
    rows = [("x/calendar", "", "enron deal " * 9), ("x", "", "short"), ("x", "Deal", "enron " + "z" * 60), ("x", None, "z" * 60), (None, None, None)]
    df = spark.createDataFrame(rows, "f string, s string, b string").select(mail.drop_reason(F.col("f"), F.col("s"), F.col("b")).alias("reason"))
    assert [r[0] for r in df.collect()] == ["folder", "length", None, "signal", "length"]
    assert tuple(mail.filter_stats(df).first()) == (5, 1, 1, 2, 1, 80.0)


def test_maildir(spark, tmp_path):
    (tmp_path / "ann/inbox").mkdir(parents=True)
    (tmp_path / "bob/sent").mkdir(parents=True)
    (tmp_path / "ann/inbox/1.").write_text('Message-ID: <t1@x>\nDate: Mon, 14 Jan 2002 08:00:00 -0600\nFrom: A <A@x.org>\nTo: b@x.org, "C, D" <c@x.org>\nCc: d@x.org\nSubject: Risk\nIn-Reply-To: <t0@x>\nReferences: <t0@x> <s@x>\n\nBody here\n')
    (tmp_path / "ann/inbox/2.").write_text("Subject: no id\n\nx")
    (tmp_path / "bob/sent/1.").write_text("Message-ID: <t2@x>\nDate: never\n\nhello")
    rows = {r.message_id: r for r in read_maildir(spark, str(tmp_path)).collect()}
    assert set(rows) == {"t1@x", "t2@x"}
    r = rows["t1@x"]
    assert (r.sender, r.recipients, r.in_reply_to, r.references) == ("a@x.org", ["b@x.org", "c@x.org", "d@x.org"], "t0@x", ["t0@x", "s@x"])
    assert r.folder_path == "ann/inbox" and r.date == dt.datetime(2002, 1, 14, 14) and r.body.strip() == "Body here" and len(r.dedup_key) == 64
    assert rows["t2@x"].date is None
    assert [r.message_id for r in read_maildir(spark, str(tmp_path), ["bob"]).collect()] == ["t2@x"]


def test_stream(spark, tmp_path):
    rows = [("a", dt.datetime(2002, 1, 1)), ("a", dt.datetime(2002, 1, 2)), ("b", dt.datetime(2002, 1, 3))]
    spark.createDataFrame(rows, "message_id string, date timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("message_id string, date timestamp").parquet(f"{tmp_path}/in")
    ingest.process_available(ingest.first_per_message(stream), lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.message_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
