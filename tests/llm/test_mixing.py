import random

from emberline.llm import mixing, registry
from tests.helpers import assert_same

SCHEMA = "doc_id long, text string, source string, size string, target string"


def test_equals_sql(spark):
    assert assert_same(spark, registry.queries()["op8_mixing"], registry.oracle_sql()["op8_mixing"], "/root/testdata/sf0.01") == 1000




def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, target = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0)
    left, open_ = goal, set(names)
    while left > 1e-9 and open_:
        total, spare = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * w[s] / total
            if target[s] > 2 * sizes[s]:
                spare += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
        left = spare
    return target


def test_hot_null_and_empty_sources(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        s = r.choice(["hot", "hot", None, "", "Z", "é", "a", "tiny"])
        n = 0 if s == "" else r.choice([0, 1, 5, 40]) if s != "hot" else r.choice([10, 2000])
        rows.append((i, None if n == 0 and i % 2 else "w " * n, s, "x", "y"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {x.doc_id: x for x in mixing.plan_mix(df).collect()}
    sizes, largest = {}, {}
    for i, t, s, *_ in rows:
        n = len((t or "").split())
        assert got[i].size == n
        assert got[i].taken <= 2 * n and got[i].taken == got[i].copies * n
        sizes[s] = sizes.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    want = targets(sizes)
    for s in sizes:
        mine = [got[i] for i, _, x, *_ in rows if x == s]
        assert abs(mine[0].target - want[s]) < 1e-6 * (1 + want[s])
        assert abs(sum(m.taken for m in mine) - want[s]) <= largest[s] / 2 + 1e-6
        assert all(0 <= p <= 1 for m in mine for p in m.positions)
    again = {x.doc_id: (x.taken, tuple(x.positions)) for x in mixing.plan_mix(df.repartition(2)).collect()}
    assert again == {k: (v.taken, tuple(v.positions)) for k, v in got.items()}


def test_training_order_is_sorted_and_repeats(spark):
    df = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3], "x", "y") for i in range(90)], SCHEMA)
    out = mixing.training_order(df)
    p = [x.position for x in out.collect()]
    assert p == sorted(p) and len(p) == 135
    assert out.columns == [*df.columns, "position"]


def test_empty_and_repeated(spark):
    assert mixing.plan_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b", "s", "", "")] * 3 + [(None, "a", "s", "", "")], SCHEMA)
    assert sorted((x.doc_id or 0, x.taken) for x in mixing.plan_mix(df).collect())[0][0] == 0
    assert mixing.plan_mix(df).count() == 4
