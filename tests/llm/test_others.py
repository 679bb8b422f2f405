import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from emberline.llm import coder, decontam, licenses, lm, repeats, tokens, toxicity, urls
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, score string, item_id long, w string, fp string"
PLAIN = (None,) * 5


def docs(spark, rows):
    return spark.createDataFrame([(i, x, *PLAIN) for i, x in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(500)}" for _ in range(n))


def test_coder_round_trip():
    r = np.random.default_rng(1)
    blocks = [np.array([], np.int64), np.array([65535]), np.full(3000, 7), r.integers(0, 65536, 2048), r.zipf(1.3, 2048) % 50000]
    start = coder.Start.of(blocks)
    coded = coder.encode(blocks, start)
    packed = start.pack()
    again = coder.Start.unpack(packed)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode(coded, again), strict=True))
    assert np.array_equal(coder.decode(coded[3:4], again)[0], blocks[3])
    assert len(coded[2]) < 200
    with pytest.raises(ValueError):
        coder.decode([coded[3][:40] + bytes([coded[3][40] ^ 1]) + coded[3][41:]], again)
    with pytest.raises(ValueError):
        coder.encode([np.array([65536])], start)
    with pytest.raises(ValueError):
        coder.Start.unpack(packed[:30] + bytes([packed[30] ^ 1]) + packed[31:])
    # a model that never met the blocks still codes them
    other = coder.Start.of([np.arange(300)])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode(coder.encode(blocks, other), other), strict=True))
    none = coder.Start.of([])
    assert np.array_equal(coder.decode(coder.encode(blocks[1:2], none), none)[0], blocks[1])


def test_coder_beats_a_table_of_frequencies():
    """All that is stored, the start included, is below the entropy of single ids and below eight bits an id."""
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' ORDER BY doc_id LIMIT 2500").fetchall()]
    ids = np.concatenate([np.append(x, 2) for x in tokens.ids_of(None).of([t or "" for t in texts])])
    blocks = [ids[k : k + coder.BLOCK] for k in range(0, len(ids), coder.BLOCK)]
    start = coder.Start.of(blocks)
    bits = 8 * (len(start.pack()) + sum(map(len, coder.encode(blocks, start)))) / len(ids)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert bits < 8.0 and bits < -(share * np.log2(share)).sum()


def test_coder_gives_frequent_ids_few_digits():
    """Every id's digits lead back to it, and the ids of texts have some two digits each rather than four."""
    ids = np.random.default_rng(3).zipf(1.2, 60000) % 50000
    for some in (ids, ids[:1], ids[:0], np.arange(65536)):
        d = coder.Start.of([some]).digits
        for x in (0, 7, 49999, 65535, *some[:300].tolist()):
            node = 0
            for k in range(d.n[x]):
                assert d.node[x * d.width + k] == node
                node = int(d.child[node * 16 + int(d.digit[x * d.width + k])])
            assert ~node == x
    assert coder.Start.of([ids]).digits.n[ids].mean() < 2.6
    text = "\n".join(r[0] or "" for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    met = tokens.ids_of(None).of([text])[0]
    assert coder.Start.of([met]).digits.n[met].mean() < 2.6


def test_ids_are_those_of_the_tokenizer():
    parts = ["a", "b", "\u00e9", "\u00aa", "the", "23", ".", ",", "'s", "'", "'ll", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "<", "|", "<|", "\u0100", "\u00b2", "_", "\u00a0", "\u65e5", "\x00", "-", "T"]
    r = np.random.default_rng(4)
    some = ["", " ", "\n", "a ", " a", "a\n", "\na", *("".join(r.choice(parts, r.integers(0, 14))) for _ in range(3000))]
    held = tokens.Ids(None)
    for _ in range(2):  # learned, then remembered
        got = [x.tolist() for k in range(0, len(some), 100) for x in held.of(some[k : k + 100])]
        assert got == [e.ids for e in held.tok.encode_batch_fast(some, add_special_tokens=False)]


def test_tokens_edges(spark):
    tok = tokens._tokenizer(None)
    rows = [(3, "a # b"), (1, None), (2, ""), (9, prose(1, 9000)), (3, "a # b")]
    got = tokens.round_trip(docs(spark, rows)).orderBy("start").collect()
    at = 0
    for r, (i, x) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = np.array([*tok.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokens.round_trip(docs(spark, [])).count() == 0


def brute_repeats(rows, window):
    first = {}
    for i, x in sorted(rows, key=lambda r: r[0]):
        w = (x or "").split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, x in rows:
        w = (x or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_repeats_equal_brute_force(spark):
    shared, run = prose(5, 80), "x " * 120
    rows = [(i, f"{prose(i, i * 7)} {shared if i % 3 == 0 else ''} {prose(99 - i, 20)}") for i in range(1, 20)]
    rows += [(30, run), (31, f"y {run} z"), (32, "a b " * 60), (33, "b a " * 70), (34, None), (35, ""), (36, rows[4][1]), (37, prose(4, 50)), (38, prose(4, 50))]
    got = repeats.remove_repeats(docs(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows, 50)
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_repeats_of_a_group_are_those_of_its_documents():
    all_texts = [prose(i, 50 + 40 * i) for i in range(6)] + ["x " * 90, "a b " * 40, f"{prose(2, 130)} {'x ' * 60}"]
    named = [repeats._hashes(x.encode().split()) for x in all_texts]
    number = list(range(len(named)))

    def marked(states):
        shared = [[k for k, name in enumerate(x) if name and (name >> 5) % 8] or None for x in states.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*states.columns, pa.array(shared, pa.list_(pa.int32()))], [*states.schema.names, "shared"])

    together = repeats._begin(number, number, named, 50, 2)
    alone = [repeats._begin([i], [i], [x], 50, 2) for i, x in enumerate(named)]
    assert together.to_pylist() == [row for b in alone for row in b.to_pylist()]
    for steps in (1, 0):
        together = repeats._go_on(marked(together), 50, steps)
        alone = [repeats._go_on(marked(b), 50, steps) for b in alone if b.num_rows]
        assert together.to_pylist() == [row for b in alone for row in b.to_pylist()]
    assert together.num_rows and repeats._begin([], [], [], 50, 2).num_rows == 0


def grams(words, k=5):
    k = min(k, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_leaks(rows, items):
    """The best window of every pair, over all windows that a shared shingle aligns with the item."""
    out = {}
    for d, x in rows:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        for item, y in items:
            v = re.findall(r"[^\W_]+", (y or "").lower())
            want, k = grams(v), min(5, len(v))
            if not v or d is None or item is None:
                continue
            starts = {max(p - q, 0) for p in range(len(w) - k + 1) for q in range(len(v) - k + 1) if w[p : p + k] == v[q : q + k]}
            for s in starts:
                have = Counter(tuple(w[i : i + k]) for i in range(s, min(s + len(v), len(w)) - k + 1))
                like = sum((have & want).values()) / sum((have | want).values())
                if like >= 0.8 and (like, -s) > out.get((d, item), (0, 0)):
                    out[d, item] = (like, -s)
    return {k: (-s, round(x, 9)) for k, (x, s) in out.items()}


def test_leaks_equal_brute_force(spark):
    item, other, twice = prose(7, 40), prose(8, 30), "a b c d e f " * 6
    near = item.split()
    near[20] = "changed"
    end = item.split()
    end[0], end[-1] = "x", "y"
    far = [w if k % 4 else "z" for k, w in enumerate(item.split())]
    items = [(1, item), (2, other), (3, "two words"), (4, None), (5, ""), (6, twice), (7, item), (8, prose(11, 120)), (None, other)]
    rows = [(1, f"{prose(1, 60)} {item} {prose(2, 9)}"), (2, " ".join(far)), (3, None), (4, ""), (5, other.upper()), (6, prose(3, 4000)), (7, "Two, words"), (None, item), (9, twice + "a b c"), (10, " ".join(end)), (11, other[:-30])]
    rows += [(8, f"{prose(4, 10)} {' '.join(near[:20])} {' '.join(near[21:])}"), (12, f"{prose(9, 3000)} {item} {prose(10, 3000)} {other} {item}"), (13, prose(11, 120).replace(" ", "\n", 3)), (14, "two")]
    bench = spark.createDataFrame([(i, x, "x") for i, x in items], "item_id long, text string, doc_id string")
    want = brute_leaks(rows, items)
    assert {(1, 1), (1, 7), (5, 2), (7, 3), (9, 6), (12, 1), (12, 2), (13, 8)} <= set(want) and not {d for d, _ in want} & {2, 3, 4, 6, 14}
    frame = docs(spark, [*rows, rows[4]])
    got = {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 9)) for r in decontam.leaks(frame, bench).collect()}
    assert got == want
    kept = decontam.clean(frame, bench)
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontam.leaks(docs(spark, []), bench).count() == 0 == decontam.leaks(frame, bench.limit(0)).count()


def test_toxicity_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    l = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    marked = l.filter(toxicity.held_out(F.col("doc_id")))
    got = toxicity.score(d.join(marked, "doc_id"), toxicity.fit(d, l)).collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    assert len(toxic) > 50 and sum(toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.01 * len(got)


def test_toxicity_is_the_difference_of_two_models():
    rows = [(k, " ".join([*prose(i, 30).split(), *(["scum", "vile scum"] if k else ["nice", "kind nice"])])) for i in range(120) for k in (i % 3 == 0,)]
    counted = [(int(k), toxicity._counted(x)) for k, x in rows]
    r = toxicity.Ratio(counted)
    assert r.mean("scum") > 1 and r.mean("nice") < -0.5 and abs(r.mean("w17 w18")) < 0.2 and abs(r.mean("never met")) < 0.2
    assert r.mean("scumbag") > 0.5  # a form that was not met is judged by its beginning
    assert abs(r.mean("scum") - r.mean("scum " * 9)) < 2.5  # by length


def test_a_long_row_does_not_drop_its_class(spark):
    rows = [(i, f"plain words {prose(i, 9)}") for i in range(1, 160)] + [(i, f"scum text scum {prose(i, 6)}") for i in range(200, 300)] + [(400, "scum " * 4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    l = spark.createDataFrame([(i, int(i >= 200)) for i, _ in rows] * 2, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(d, toxicity.fit(d, l, max_chars=9000)).collect()}
    assert all(got[i] == (i >= 200) for i, _ in rows)


def test_toxicity_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    rows = docs(spark, [(1, None), (2, ""), (None, "x"), (2, "")])
    got = toxicity.score(rows, toxicity.fit(rows, empty)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.score(rows.limit(0), toxicity.fit(rows.limit(0), empty)).count() == 0


def test_licenses(spark):
    rows = [(1, "x. Released under the MIT License."), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (5, "the MIT License")]
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.license) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {1: ("1", "MIT", "MIT"), 2: ("", "", None), 3: ("", "", None), 4: ("2,1", "Apache-2.0,MIT", "Apache-2.0"), 5: ("", "", None)}


def test_urls(spark):
    link = '<a href="http://bad.org/x">'
    rows = [
        (1, "http://A.Example.com/en/x?y", None), (2, "https://www.example.com/en/1", ""), (3, "x", None), (4, None, None), (5, "http://s.net/es/1", None),
        (6, "http://s.net", None), (7, "http://far.org/p#q", '<a href="http://s.net/es/">'), (8, "http://com/", None), (9, "http://ecom/", None), (9, "http://ecom/", None), (10, "://q", link),
        (11, "http://two.org/", '<A class=x HREF=//far.org/>'), (12, "http://away.org/", '<base target=_top href="HTTP://TWO.org/dir/"><a data-href="http://no.org/" href="y?u=http://z/">'),
        (13, "http://alone.org/", '<a href="/x"><a href="mailto:a@s.net"><a data-href="//s.net/"><a href="#s.net">'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(df).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3] == ("", "", None, "allow") == got[4] and got[5][2] == "net/es/" and got[6] == ("s.net", "", None, "block")
    assert got[7] == ("far.org", "/p", None, "block") and got[8][2] == "com/" and got[9] == ("ecom", "/", None, "allow") and got[10][0] == "q"
    # two and three links from the blocked host, by a link without scheme and by the base of a relative one
    assert got[11][3] == "block" == got[12][3] and got[13][3] == "allow"
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_odd_columns_and_texts(spark):
    """Clashing names, as much trust as distrust, very long and unclosed html, repeated rows."""
    rows = [(1, "http://s.net/es/1", None), (2, "http://www.example.com/en/", None), (3, "http://tie.org/", '<a href="http://s.net/">' + "<a x " * 200000), (4, "http://s.net/", "<p>" * 300000), (5, "http://t.example.com/", None)]
    df = spark.createDataFrame([(*r, "z", 0, "v") for r in rows * 2], "page_id int, url string, html string, host string, rule int, verdict string")
    got = [(r.page_id, r.host, r.verdict) for r in urls.judge(df).orderBy("page_id").collect()]
    assert got == [(i, h, v) for i, h, v in [(1, "s.net", "block"), (2, "www.example.com", "allow"), (3, "tie.org", "block"), (4, "s.net", "block"), (5, "t.example.com", "allow")] for _ in (0, 1)]
    even = [(1, "http://s.net/es/1", '<a href="http://x.org/">'), (2, "http://www.example.com/en/", '<a href="http://x.org/">'), (3, "http://x.org/", '<a href="//s.net"><a href="//other.org">'), (4, "http://www.example.com/en/", None)]
    judged = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(even, "page_id int, url string, html string")).collect()}
    assert judged[1] == "block" and judged[2] == "allow"


def brute_judge(rows, steps=2000):
    """The whole method with matrices: ranks with dangling mass handed back to the seeds, at rest."""
    hosts = sorted({h for h, _, _ in rows} | {b for _, _, to in rows for b in to})
    n, at = len(hosts), {h: i for i, h in enumerate(hosts)}
    links = np.zeros((n, n))
    for h, _, to in rows:
        for b in to:
            links[at[h], at[b]] += b != h
    rank = {}
    for kind, move in (("allow", links), ("block", links.T)):
        seed = np.array([sum(1.0 for h, v, _ in rows if h == x and v == kind) for x in hosts])
        seed /= seed.sum()
        out = move.sum(1)
        x = seed
        for _ in range(steps):
            x = 0.15 * seed + 0.85 * (move.T @ np.divide(x, out, out=np.zeros(n), where=out > 0) + x[out == 0].sum() * seed)
        rank[kind] = x
    return {h: "block" if rank["block"][at[h]] > rank["allow"][at[h]] else "allow" for h in hosts}


def test_urls_equal_matrices(spark):
    rng = random.Random(11)
    names = [f"h{i:02}.org" for i in range(30)]
    rules = [("allow", f"{h}/") for h in names[:3]] + [("block", f"{h}/") for h in names[3:6]]
    rows = [(h, {0: "allow", 1: "block"}.get(k // 3), [rng.choice(names) for _ in range(rng.randrange(0, 4))]) for k, h in enumerate(names) for _ in range(2)]
    pages = [(i, f"http://{h}/", "".join(f'<a href="http://{b}/p">' for b in to)) for i, (h, _, to) in enumerate(rows)]
    want = brute_judge(rows)
    got = urls.judge(spark.createDataFrame(pages, "page_id int, url string, html string"), rules, tolerance=1e-8).collect()
    judged = {r.host: r.verdict for r in got if r.rule is None}
    assert judged == {h: want[h] for h in judged} and len(set(judged.values())) == 2


def test_ranks_equal_power_iteration(spark):
    rng = random.Random(4)
    names = [f"h{i:02}" for i in range(25)]
    out = {a: sorted({rng.choice(names) for _ in range(rng.randrange(1, 5))} - {a}) for a in names}
    edges = [("k", a, b, 1 / len(bs)) for a, bs in out.items() for b in bs]
    seeds = [("k", "h00", 0.75), ("k", "h07", 0.25)]
    got = {r.host: r["rank"] for r in urls.spread(spark.createDataFrame(edges, "kind string, a string, b string, share double"), spark.createDataFrame(seeds, "kind string, host string, seed double"), tolerance=1e-7).collect()}
    start = np.array([dict((h, w) for _, h, w in seeds).get(n, 0.0) for n in names])
    step = np.zeros((25, 25))
    for _, a, b, w in edges:
        step[names.index(b), names.index(a)] = w
    rank = start
    for _ in range(400):
        rank = 0.15 * start + 0.85 * step @ rank
    assert np.allclose([got.get(n, 0.0) for n in names], rank, atol=1e-6)


def brute_lm(rows, targets, vocabulary):
    """The same models with dictionaries, one document after the other."""
    words = {i: [w.encode() for w in (x or "").lower().split()] for i, x in enumerate(x for _, x in rows)}
    count = Counter(w for ws in words.values() for w in ws)
    signed = lambda w: np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64)
    known = {w for w, _ in sorted(count.items(), key=lambda x: (-x[1], signed(x[0])))[:vocabulary]}
    size = len(known) + 2
    pair, before, single, total = ([[Counter(), Counter()], [Counter(), Counter()]] for _ in range(4))
    parts = []
    for i, (doc, x) in enumerate(rows):
        ws = [w if w in known else 0 for w in words[i]]
        half, kind = lm._half((x or "").encode()), int(doc in targets)
        parts.append((doc, half, list(zip([1, *ws], ws, strict=False))))
        for v, w in parts[-1][2]:
            pair[half][kind][v, w] += 1
            before[half][kind][v] += 1
            single[half][kind][w] += 1
            total[half][kind][0] += 1
    out, n = Counter(), Counter()
    for doc, half, ps in parts:
        g = 1 - half
        t, b = total[g][1][0], total[g][0][0]
        scale = [t / b if b else 0, 1.0]
        for v, w in ps:
            p = [(scale[k] * pair[g][k][v, w] + lm.WEIGHT * (scale[k] * single[g][k][w] + lm.ADD) / (scale[k] * total[g][k][0] + lm.ADD * size)) / (scale[k] * before[g][k][v] + lm.WEIGHT) for k in (0, 1)]
            out[doc] += math.log(p[1] / p[0])
        n[doc] += len(ps)
    return {d: (n[d], out[d] / n[d] if n[d] else 0.0) for d, _, _ in parts}


def test_lm_equals_brute_force(spark):
    rows = [(i, f"{'good fine text' if i % 4 == 0 else 'other junk words'} {prose(i, 12)}") for i in range(80)] + [(200, None), (201, ""), (202, rows_text := prose(3, 3000)), (203, rows_text), (4, "the same id"), (None, "no id at all")]
    targets = {i for i in range(0, 80, 4) if i % 8}
    ids = spark.createDataFrame([(i,) for i in targets] * 2 + [(None,)], "doc_id long")
    want = brute_lm(rows, targets, 60)
    for hot in (10, 1 << 20):
        got = {r.doc_id: (r.n_words, r.score) for r in lm.score(docs(spark, rows), ids, vocabulary=60, hot=hot).collect()}
        assert set(got) == set(want) and all(got[d][0] == n and abs(got[d][1] - s) < 1e-5 for d, (n, s) in want.items())
    assert min(want[i][1] for i in range(0, 80, 8)) > max(want[i][1] for i in range(1, 80, 4))  # targets that were not marked
    assert lm.score(docs(spark, []), ids).count() == 0
    assert {r.score for r in lm.score(docs(spark, rows), ids.limit(0)).collect()} == {0.0}


def test_license_rules_use_up_their_sentences(spark):
    known, rules = {"a one": 1, "b two": 2, "c three": 3}, (("AB", (1, 2)), ("B", (2,)), ("A", (1,)))
    rows = [(1, "A one. B two. "), (2, "A one. B two. B two."), (3, "B two.\n\nA one!"), (4, None), (5, "c three"), (1, "A one. B two. "), (6, "x " * 50000 + ". A one.")]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(docs(spark, rows), known, rules).collect()}
    assert got == {1: ("1,2", "AB"), 2: ("1,2,2", "AB,B"), 3: ("2,1", "B,A"), 4: ("", ""), 5: ("3", ""), 6: ("1", "A")}
    assert licenses.scan(docs(spark, [])).count() == 0


def test_registry_names():
    from emberline.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_pair_counts_are_shuffled_once(spark, monkeypatch):
    plans, store = {}, lm.stored

    def seen(df, name="t"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return store(df, name)

    monkeypatch.setattr(lm, "stored", seen)
    docs = spark.createDataFrame([(k, f"a b c{k % 3} d") for k in range(12)], "doc_id long, text string")
    assert lm.score(docs, docs.filter("doc_id < 6").select("doc_id")).count() == 12
    assert "hashpartitioning(" in plans["pairs"] and "hashpartitioning(key" not in plans["pairs"]


def test_no_pair_is_joined_to_documents(spark, monkeypatch):
    """Rows that are shuffled are lists by chunk and part, as many for rare pairs as for frequent ones."""
    plans, store = [], lm.stored

    def seen(df, name="t"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(lm, "stored", seen)
    docs = spark.createDataFrame([(k, f"a b c{k % 3} d{k}") for k in range(12)], "doc_id long, text string")
    lm.score(docs, docs.filter("doc_id < 6").select("doc_id"), hot=1)
    assert plans and not any("Join" in p or "Generate" in p for p in plans)
    whole = docs.selectExpr("CAST(doc_id AS int) AS doc_id", "text")
    got = {r.doc_id: r.score for r in lm.score(whole, docs.filter("doc_id < 6").select("doc_id")).collect()}
    assert len(got) == 12 and any(got.values())
