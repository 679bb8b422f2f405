"""Greedy merges against one pass in order, name pairs against all pairs."""

import random

import pytest
from emberline.functions.names import ratio, similarity
from emberline.operators import nameparts, resolution

PAIRS = "a string, b string, sim double, na int, nb int"


def one_pass(rows):
    gone, out = set(), set()
    for a, b, sim, na, nb in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in gone and b not in gone:
            stays, goes = (a, b) if na >= nb else (b, a)
            gone.add(goes)
            out.add((goes, stays, sim))
    return out


def graph(seed, nodes, edges):
    r = random.Random(seed)
    size = {f"n{i:04d}": r.randrange(3, 9) for i in range(nodes)}
    names = sorted(size)
    met = {tuple(sorted(r.sample(names, 2))) for _ in range(edges)}
    return [(a, b, r.choice([0.82, 0.9, 0.95]) if r.random() < 0.4 else round(r.uniform(0.82, 1), 4), size[a], size[b]) for a, b in sorted(met)]


@pytest.mark.parametrize("most", [0, 12, 1 << 18])
def test_rounds_equal_one_pass(spark, most):
    rows = graph(1, 60, 90) + [(f"x{a}", f"x{b}", *rest) for a, b, *rest in graph(2, 30, 20)]
    got = {tuple(r) for r in resolution.greedy_merges(spark.createDataFrame(rows, PAIRS), most=most, rounds=3).collect()}
    assert got == one_pass(rows)


def test_a_long_chain(spark):
    rows = [(f"n{i:06d}", f"n{i + 1:06d}", 0.9, 5 + i % 3, 5 + (i + 1) % 3) for i in range(20_000)]
    got = {tuple(r) for r in resolution.greedy_merges(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == one_pass(rows)


def test_no_pairs(spark):
    assert resolution.greedy_merges(spark.createDataFrame([], PAIRS)).count() == 0


def typed(r, word):
    """The word with up to two letters exchanged, dropped or added anywhere, its first one included."""
    w = list(word)
    for _ in range(r.randrange(3)):
        at = r.randrange(len(w) + 1)
        w[at : at + r.randrange(2)] = [r.choice("abcdeorstl ")] if r.random() < 0.6 else []
    return "".join(w).strip() or "x"


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85])
def test_parts_equal_all_pairs(spark, least):
    r = random.Random(3)
    stems = ["li", "smith", "oneill", "johnson", "aaaaabbbb", "abababababab", "schwarzenegger", "wolfeschlegelstein", "münchhausen", "j"]
    parts = sorted({typed(r, r.choice(stems)) for _ in range(250)})
    got = {tuple(x) for x in nameparts.similar_parts(spark.createDataFrame([(p,) for p in [*parts, parts[0], "", None]], "part string"), least).collect()}
    assert got == {(a, b) for a in parts for b in parts if a < b and ratio(a, b) >= least - 1e-9}


def test_names_equal_all_pairs(spark):
    """Two thousand names with typing errors, in their first letters too, middle names, commas and initials."""
    r = random.Random(4)
    first = ["John", "Jon", "Katherine", "Bob", "Maximilian", "J", "Al", "Wu", "Élodie"]
    last = ["Smith", "Lay", "Fernandez", "Oh", "Christodoulopoulos", "Baker", "Skilling", "Nguyen", "Zhang"]
    middle = ["", "", "", "Q.", "van der", "Fitzgerald Alexander"]
    rows = []
    for i in range(2000):
        f, m, z = typed(r, r.choice(first)), r.choice(middle), typed(r, r.choice(last))
        rows.append((f"e{i:04d}", f"{z}, {f}" if r.random() < 0.1 else f"{f} {m} {z}", r.choice(["Person", "Topic"]), [], {}))
    found = resolution.similar_pairs(spark.createDataFrame(rows, "id string, canonical_name string, entity_type string, aliases array<string>, properties map<string,string>"))
    got = {(x.a, x.b): round(x.sim, 9) for x in found.collect()}
    known, want = {}, {}
    for k, (a, x, kind, *_) in enumerate(rows):
        for b, y, other, *_ in rows[k + 1 :]:
            if kind == other:
                pair = (min(x, y), max(x, y))
                if pair not in known:
                    known[pair] = similarity(*pair)
                if known[pair] >= resolution.THRESHOLD:
                    want[a, b] = round(known[pair], 9)
    assert got == want and len(want) > 3000
