"""MinHash bands, inverted files and trigram prefixes against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from emberline.operators import ann, lsh, neardup, trigram
from emberline.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def shingles(text, k=5):
    t = re.sub(r"^\s+|\s+$", "", (text or "").lower())
    return {t} if len(t) < k else {t[i : i + k] for i in range(len(t) - k + 1)}


def test_signatures_equal_brute_force(spark):
    texts = {1: "abcdefgh", 2: "", 3: "Some longer text, é and 日本語", 4: None, 5: "abcdefgh"}
    sets = lsh.shingle_sets(spark.createDataFrame(list(texts.items()), "doc_id int, text string"))
    got = {r.node: r.signature for r in lsh.whole(lsh.signatures(sets, bands=3, rows=2)).collect()}
    assert set(got) == {1, 2, 3}
    for i in got:
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(texts[i])]
        signed = lambda x: x - (x >> 63 << 64)
        both = lambda h, n: signed(xxhash.xxh64_intdigest(n.to_bytes(8, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)))
        assert got[i] == [min(both(h, n) for h in hashes) for n in range(6)]


def test_recall_of_bands_against_the_exact_join(spark):
    r = random.Random(4)
    base = [" ".join(f"w{r.randrange(900)}" for _ in range(60)) for _ in range(40)]
    rows = []
    for i, text in enumerate(base):
        words = text.split()
        for copy in range(4):
            for _ in range(copy):
                words[r.randrange(60)] = f"x{r.randrange(9)}"
            rows.append((4 * i + copy, " ".join(words)))
    rows += [(1000 + i, base[0]) for i in range(30)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    exact = {(p.a, p.b): p.similarity for p in neardup.near_pairs(docs).collect()}
    found = {(p.a, p.b): p.similarity for p in lsh.near_pairs(docs).collect()}
    assert found.items() <= exact.items() and len(exact) > 60
    assert len(found) / len(exact) >= 0.9
    hard = [p for p, s in exact.items() if s < 0.9]
    assert len(hard) > 10 and sum(p in found for p in hard) / len(hard) >= 0.9


def test_query_of_bands(spark):
    path = "/root/testdata/sf0.001"
    exact = {tuple(x) for x in catalog.queries()["j8_near_pairs"](spark, path).collect()}
    found = {tuple(x) for x in catalog.queries()["j8_lsh_pairs"](spark, path).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact)


def test_inverted_file(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    more = spark.createDataFrame([(10**6, [0.0] * 64), (10**6 + 1, None), (None, [1.0] * 64)], "id long, embedding array<float>")
    every, asked = e.unionByName(more), e.filter("id % 10 = 0").unionByName(more)
    exact = {}
    rows = [(r.id, np.array(r.embedding, float)) for r in e.collect()]
    ids, m = np.array([i for i, _ in rows]), np.stack([v / np.linalg.norm(v) for _, v in rows])
    for k in np.flatnonzero(ids % 10 == 0):
        line = np.round(m @ m[k], 6)
        line[k] = -2
        exact[int(ids[k])] = ids[np.lexsort((ids, -line))[:10]].tolist()
    centres = ann.fit(every)
    listed = ann.index(every, centres).persist()
    assert listed.count() == e.count()

    def recall(probes, chunk=4096):
        got = {}
        for r in ann.search(listed, asked, centres, probes=probes, chunk=chunk).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        return np.mean([len(set(got.get(i, [])) & set(want)) / 10 for i, want in exact.items()])

    assert recall(ann.LISTS, chunk=7) == 1.0
    assert recall(ann.PROBES) >= 0.9
    assert ann.scanned(listed, asked, centres) < 0.75
    assert ann.search(ann.index(every.limit(0), ann.fit(every.limit(0))), asked, ann.fit(every.limit(0))).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_trigram_prefixes_lose_nothing(spark, threshold):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé1") for _ in range(r.randrange(1, 7)))
    known = list({" ".join(word() for _ in range(r.randrange(1, 4))) for _ in range(400)}) + ["", "--", None, "a"]
    asked = r.sample(known, 60) + ["no such thing", "aaaa aaaa"]

    def grams(name):
        return {f"  {w} "[i : i + 3] for w in re.split(r"[^\w]+", name.lower()) if w for i in range(len(w) + 1)}

    want = {}
    for q in asked:
        for n in known:
            a, b = grams(q or ""), grams(n or "")
            if a and b and len(a & b) / len(a | b) > threshold:
                want[q, n] = len(a & b) / len(a | b)
    frame = lambda names: spark.createDataFrame([(x,) for x in names], "name string")
    got = {(x.q, x.name): x.similarity for x in trigram.similar_names(frame(asked), frame(known + known[:9]), threshold).collect()}
    assert got == want


def test_trigram_candidates_are_few_and_no_loop(spark):
    parts = spark.read.parquet(f"{SF}/customer.parquet").select(F.col("c_name").alias("name"))
    sets = parts.select("name", F.expr("filter(array('x'), x -> false)").alias("g")).limit(0)
    assert trigram.candidates(sets, sets, 0.3).count() == 0
    names = spark.createDataFrame([(f"{a}{b} {c}{a}",) for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"], "name string")
    from emberline.functions.names import trigrams

    g = names.select("name", trigrams(F.col("name")).alias("g"))
    met = trigram.candidates(g.limit(40), g, 0.3)
    assert met.count() < 0.4 * 40 * 600
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and "Cartesian" not in met._jdf.queryExecution().toString()


def test_bands_shuffle_less_than_the_sets(spark, tmp_path):
    from tests.test_setjoin import shuffled

    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    docs = spark.createDataFrame([(i, "".join(r.choices(letters, k=4000))) for i in range(400)], "doc_id long, text string")
    docs = docs.unionByName(docs.select((docs.doc_id + 1000).alias("doc_id"), F.concat("text", F.lit("!")).alias("text")))
    docs.write.parquet(str(tmp_path / "d"))
    before = shuffled(spark)
    found = lsh.near_pairs(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert {(p.a, p.b) for p in found} == {(i, i + 1000) for i in range(400)}
    assert shuffled(spark) - before < 3 * 800 * 4000


def test_signatures_of_texts_equal_those_of_their_sets(spark):
    r = random.Random(6)
    many = "".join(chr(0x4E00 + i) for i in range(9000))
    texts = ["", None, " a ", "abcd", "abcde", "ABCDE  ", "\U0001f600\U0001f601é\U0001f600x\U0001f600", many, many[::-1] + "x" * 9]
    texts += [" ".join(r.choice(["one", "two", "three", "Straße"]) for _ in range(r.randrange(60))) for _ in range(50)]
    rows = [(i, x) for i, x in enumerate(texts + texts[:20])]
    docs = spark.createDataFrame([*rows, (None, "lost"), rows[5]], "doc_id int, text string").repartition(3)
    want = {x.node: x.minima for x in lsh.signatures(lsh.shingle_sets(docs), 1, 16).collect()}
    got = {x.node: x.minima for x in lsh.text_signatures(docs, count=16).collect()}
    assert got == want and len(want) == len({x or "" for x in texts})


def test_a_shingle_of_many_texts_is_hashed_once():
    # before, each set was permuted on its own
    hashes, which, starts = lsh.shingle_places(["abcdefg", "", "abcdefgh", "xy", "bcdefgh"] * 100, 5)
    assert len(hashes) == 4 + 2 * 100 and len(starts) == 500 and len(which) == 100 * (3 + 1 + 4 + 1 + 3)
