"""The near-duplicate stage of the pipeline against brute force over exact shingle similarity."""

import itertools
import random
import zlib

import corpus_pipeline
import numpy as np
from emberline.llm import mixing, nearsets, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    sets = [shingles(x) for _, x in rows]
    least = {i: i for i, _ in rows}
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(zip([i for i, _ in rows], sets, strict=True), 2) if x == y or 9 * len(x & y) >= 4 * (len(x) + len(y))]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


def corpus():
    r = random.Random(3)
    prose = lambda n: [f"w{r.randrange(900)}" for _ in range(n)]
    rows, line = [], prose(12)
    for k in range(40):
        w = prose(r.choice([30, 100, 200]))
        rows.append(w)
        for _ in range(3):
            c = list(r.choice(rows[-3:]))
            for _ in range(r.choice([1, 1, 2, 4])):
                c[r.randrange(len(c))] = "changed%d" % r.randrange(99)
            rows.append(c)
    rows += [line + prose(60) for _ in range(30)]
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, None), (901, " "), (902, "two words"), (903, "Two  words"), (904, "other")]


def test_near_stage_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    assert sum(i != c for i, c in want.items()) > 40
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows] + [(None, rows[0][1], "en", "s", 0)], SCHEMA).repartition(3)
    for chunk in (nearsets.CHUNK, 3):
        monkeypatch.setattr(nearsets, "CHUNK", chunk)
        got = {r.doc_id: r.component_id for r in nearsets.near_duplicates(df).collect()}
        assert got == want | {None: None}
    kept = corpus_pipeline.keep_one_of_near(spark, df, "unused")
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}
    assert corpus_pipeline.keep_one_of_near(spark, df.limit(0), "unused").count() == 0


def test_bands_meet_at_the_threshold():
    r = np.random.default_rng(4)
    for _ in range(200):
        s = np.unique(r.integers(0, 2**63, 100).astype(np.uint64))
        other = np.unique(np.concatenate([s[:89], r.integers(0, 2**63, len(s) - 89).astype(np.uint64)]))
        assert set(nearsets.band_keys(s).tolist()) & set(nearsets.band_keys(other).tolist())


def planted(tmp_path, spark):
    """A small corpus with toxic documents, copies and leaks, and columns whose names operators use themselves."""
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randrange(700)}" for _ in range(n))
    bad = lambda: " ".join(r.choice(["scum", "vile", prose(9)]) for _ in range(60))
    rows, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        rows.append((i, bad() if toxic else prose(150)))
        labels.append((i, 1, int(toxic)))
    item = prose(40)
    rows += [(300, bad()), (301, rows[1][1]), (302, f"{prose(30)} {item} {prose(30)}"), (303, None), (304, ""), (305, rows[1][1] + " more")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, position string, _h long"
    spark.createDataFrame([(i, x, "en", "ab"[i % 2], len(x or ""), 7.0, 9, "p", 5) for i, x in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return dict(rows)


def test_stages_do_what_they_say(spark, tmp_path):
    rows = planted(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: sorted(x.doc_id for x in df.select("doc_id").collect())
    clean = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.select("score", "predicted").distinct().collect() == [(7.0, 9)]
    assert ids(clean) == [i for i in rows if i % 4 and i < 200 or i > 300]
    assert ids(corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))) == sorted(set(rows) - {302})
    near = corpus_pipeline.keep_one_of_near(spark, docs, str(tmp_path))
    assert not {301, 305, 304} & set(ids(near)) and {1, 303} <= set(ids(near))
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.select("position").distinct().collect() == [("p",)]
    for stage in (f for _, f in corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_writes_ids_in_training_order(spark, tmp_path):
    rows = planted(tmp_path, spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_leaks(spark, corpus_pipeline.keep_one_of_near(spark, corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)), str(tmp_path)), str(tmp_path))
    plan = mixing.plan_mix(kept).collect()
    order = [d for _, d in sorted((p, r.doc_id) for r in plan for p in r.positions)]
    got = out.orderBy("start").collect()
    assert [r.doc_id for r in got] == order and len(order) > 150
    tok, at = tokens._tokenizer(None), 0
    for r in got:
        ids = np.array([*tok.encode(rows[r.doc_id] or "", add_special_tokens=False).ids, tokens.END], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_fingerprints_lead_to_copies_without_bands(spark, monkeypatch):
    """SimHash alone brings copies within its radius together; the exact step still decides."""
    monkeypatch.setattr(nearsets, "band_keys", lambda s: np.empty(0, np.int64))
    r = random.Random(11)
    words = [f"w{r.randrange(5000)}" for _ in range(3000)]
    near, far = [*words[:-1], "changed"], [f"v{r.randrange(5000)}" for _ in range(3000)]
    rows = [(7, " ".join(words)), (3, " ".join(near)), (9, " ".join(far)), (12, None), (13, " ")]
    sets = [nearsets.shingle_set(x.encode(), 5) for _, x in rows[:3]]
    bits = lambda a, b: (nearsets.fingerprint(sets[a]) ^ nearsets.fingerprint(sets[b])).bit_count()
    assert bits(0, 1) <= nearsets.RADIUS < bits(0, 2)
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], SCHEMA)
    assert {r.doc_id: r.component_id for r in nearsets.near_duplicates(df).collect()} == {7: 3, 3: 3, 9: 9, 12: 12, 13: 12}
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_near(spark, df, "unused").collect()} == {3, 9, 12}


def test_near_duplicates_read_small_arrow_batches(spark, monkeypatch):
    name, met, store = "spark.sql.execution.arrow.maxRecordsPerBatch", [], nearsets.stored
    before = spark.conf.get(name)

    def seen(*a):
        met.append(int(spark.conf.get(name)))
        return store(*a)

    monkeypatch.setattr(nearsets, "stored", seen)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearsets.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert met and max(met) <= 1024 and spark.conf.get(name) == before
