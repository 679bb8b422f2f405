import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from emberline.llm import registry, resample

DOCS = "doc_id long, text string, rank long, score string, part int, run string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 7, "s", 1, "r") for i, x in rows], DOCS)


def brute(docs, target, percent=5, least=20):
    """The contract, read word by word."""

    def found(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(x.encode()) % 10000 for x in runs]

    have, want = Counter(), Counter()
    for _, x in docs:
        have.update(found(x)[1])
    for x in target:
        want.update(found(x)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((have[b] + 1) * (t + 10000))))
    rows, able = [], []
    for i, x in docs:
        n, runs = found(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, runs))
        row = [i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        rows.append(row)
        if n >= least:
            able.append(row)
    able.sort(key=lambda r: (-r[3], (0, 0) if r[0] is None else (1, r[0])))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return rows


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def prose(r, n):
    return " ".join(r.choice(["Über", "a1", "THE", "naïve", "x,y", "k\x00z", f"w{r.randrange(60)}"]) for _ in range(n))


@pytest.mark.parametrize(("percent", "size"), [(5, 1 << 17), (37, 4), (100, 9), (0, 4)])
def test_equals_brute_force(spark, percent, size):
    r = random.Random(5)
    rows = [(i, prose(r, r.choice([3, 19, 20, 21, 60]))) for i in range(300)] + [(900, None), (901, ""), (902, prose(r, 30_000))]
    rows += [(500, rows[4][1])] * 40 + [(None, prose(r, 25))] * 30 + [(None, prose(r, 40))]
    target = [prose(r, 50) + " W3 w4 w5" for _ in range(9)] + [None]
    got = resample.resample(frame(spark, rows).repartition(7), spark.createDataFrame([(x,) for x in target], "text string"), percent=percent, range_size=size)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(got.collect()) == order(brute(rows, target, percent))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    assert order(registry.queries()["op11_resample"](spark, sf).collect()) == order(brute(docs, target))


def test_empty_tables_and_string_ids(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(frame(spark, []), none).count() == 0
    few = resample.resample(frame(spark, [(1, "a b"), (2, None)]), none).collect()
    assert order(few) == order(brute([(1, "a b"), (2, None)], []))
    rows = [(f"id{i % 50}", " ".join(f"w{(i * k) % 13}" for k in range(25))) for i in range(100)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id string, text string"), none, percent=20).collect()
    assert order(got) == order(brute(rows, [], 20))


def test_tournament_merges_runs():
    r = random.Random(2)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((r.randrange(50), i) for _ in range(r.randrange(20))) for i in range(k)]
        merged = list(resample.Tournament([iter([(x, x) for x in run]) for run in runs]))
        assert [x for x, _ in merged] == sorted(x for run in runs for x in run)


def test_a_runs_crc_continues_that_of_its_words():
    n, found = resample.features("One two-THREE é".encode())
    assert n == 4
    assert found.tolist() == [zlib.crc32(x.encode()) for x in ("one", "two", "three", "é", "one two", "two three", "three é", "one two three", "two three é")]
    assert resample.features(b"")[1].dtype == np.int64
