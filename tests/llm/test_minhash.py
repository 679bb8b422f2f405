import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from emberline.llm import minhash

SCHEMA = "doc_id long, text string, packed string, source string"


def h(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w, seed)
    return seed >> 1


ORDERS = minhash.orders()


def brute(text):
    w = text.encode().split()
    hs = [h(w[i : i + 5]) for i in range(len(w) - 4)] or [h([b" ".join(w)])]
    bins = {}
    for x in hs:
        bins[x >> 56] = min(x, bins.get(x >> 56, x))
    return "".join("%02x" % (bins[next(i for i in [j, *ORDERS[j]] if i in bins)] & 255) for j in range(128))


def near(a, b):
    m = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 256, 2)) / 128
    return max(0, (m - 1 / 256) / (255 / 256))


def test_fingerprints_and_next(spark):
    r = random.Random(2)
    rows = {}
    for i in range(60):
        rows[i * 7 - 30] = " ".join(r.choice(["a", "É", "\U0001f600b", "word"]) + str(r.randrange(60)) for _ in range(r.choice([0, 2, 5, 30, 900])))
    rows[-23] = None
    rows[5] = " \t "
    rows[12] = rows[19] = rows[33]
    df = spark.createDataFrame([(d, t, "clash", "s") for d, t in rows.items()], SCHEMA).repartition(3)
    for buckets in (1, 7):
        out = minhash.edited_pairs(df, buckets).withColumns({c: minhash.as_text(F.col(c)) for c in ("packed", "edited_packed")})
        got = {x.doc_id: x for x in out.collect()}
        ids = sorted(rows)
        assert sorted(got) == ids
        for k, d in enumerate(ids):
            t, nxt = rows[d] or "", rows[ids[(k + 1) % len(ids)]] or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            g = got[d]
            assert g.n_chars == len(t)
            assert g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert g.packed == brute(t), (d, t[:50])
            assert g.edited_packed == brute(edited)
            assert abs(g.near_edited - near(brute(t), brute(edited))) < 1e-12
            assert abs(g.near_next - near(brute(t), brute(nxt))) < 1e-12


def test_likeness_tracks_jaccard(spark):
    r = random.Random(9)
    words = ["w%d" % r.randrange(10**6) for _ in range(1200)]
    pairs = [(i, " ".join(words[:1000]), " ".join(words[: 1000 - i] + words[1000 : 1000 + i]), "") for i in (0, 50, 200)]
    df = spark.createDataFrame(pairs, "doc_id long, a string, b string, c string")
    df = minhash.with_fingerprint(minhash.with_fingerprint(df, "a", "fa"), "b", "fb")
    for x in df.select("doc_id", minhash.likeness(F.col("fa"), F.col("fb")).alias("j")).collect():
        same = 996 - x.doc_id
        assert abs(x.j - same / (2 * 996 - same)) < 0.13


def test_empty_single_and_repeated(spark):
    assert minhash.edited_pairs(spark.createDataFrame([], SCHEMA), 4).count() == 0
    one = minhash.edited_pairs(spark.createDataFrame([(3, "a b c d", "", "")], SCHEMA), 4).collect()
    assert len(one) == 1 and one[0].near_next == 1
    rows = [(1, "x y", "", ""), (1, "x y", "", ""), (1, "other", "", ""), (None, "n", "", ""), (2, "z", "", "")]
    assert minhash.edited_pairs(spark.createDataFrame(rows, SCHEMA), 3).count() == 5
