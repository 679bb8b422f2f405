import random

import numpy as np
import pytest
import xxhash

from emberline.llm import nearsets, simhash

SCHEMA = "doc_id long, text string, lang string, fp string, component string"


def brute(rows, radius=2):
    fps = {}
    for d, t in rows:
        table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
        w = (t or "").translate(table).encode().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= radius and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {d: (fps[d], comp[d]) for d in fps}


def corpus(n=120):
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(300)] + ["É", "naïve", "\U0001f600"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "two words"), (6, "nb sp x y z")]
    for i in range(7, n):
        if i % 3 == 0:
            base = rows[r.randrange(7, i)][1] if i > 10 else "a b c d"
            w = base.split()
            w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, " ".join(w).upper() if i % 2 else "\n".join(w)))
        else:
            rows.append((i, " ".join(r.choice(vocab) for _ in range(r.choice([4, 60, 400])))))
    rows.append((n, "long " + "x y z q " * 30000))
    return rows


@pytest.mark.parametrize("radius", [2, 7])
def test_near_duplicates_equal_brute_force(spark, radius):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "en", "clash", "clash") for d, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df, 3, radius).collect()}
    assert got == brute(rows, radius)


def test_edges_of_input(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (9, "A B C D")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (5, 5), (5, 5), (9, 5)]


def test_blocks_dealt_in_chunks_lose_no_link(spark):
    r = np.random.default_rng(1)
    base = int(r.integers(0, 2**63))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 20, (150, 2))} | {int(x) for x in r.integers(0, 2**62, 60)})
    df = spark.createDataFrame([(i, f, 0) for i, f in enumerate(fps)], "node long, fp long, size long")
    from emberline.operators.components import connected_components

    got = {(x.node, x.component) for x in connected_components(simhash.link_fingerprints(df, 2, chunk=8)).collect()}
    comp = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    want = {(i, c) for i, c in enumerate(comp) if comp.count(c) > 1}
    assert got == want


def test_ratio_keeps_texts_of_other_sizes_apart(spark):
    df = spark.createDataFrame([(0, 5, 10), (1, 5, 11), (2, 5, 40), (3, 4, 42)], "node long, fp long, size long")
    got = {tuple(sorted(x)) for x in simhash.link_fingerprints(df, 2, ratio=0.8).collect()}
    assert got == {(0, 1), (2, 3)}


def test_ids_of_another_integer_type(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)]
    for kind in ("int", "short", "long"):
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=3, radius=2).collect()}
        assert got == {1: 1, 2: 1, 3: 3}
        assert {r.doc_id: r.component_id for r in nearsets.near_duplicates(docs, words=5, similarity=0.8).collect()}.items() >= {(1, 1), (2, 1)}
