"""The exact join of shingle sets against all pairs, in small blocks and chunks, and what it shuffles."""

import random
import re

import pytest
from emberline.operators import neardup, setjoin


def shuffled(spark):
    """Bytes that all stages of the session have shuffled so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None).iterator()
    n = 0
    while stages.hasNext():
        n += stages.next().shuffleWriteBytes()
    return n


def shingles(text, k=5):
    t = re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", (text or "").lower())
    return {t} if len(t) < k else {t[i : i + k] for i in range(len(t) - k + 1)}


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_pairs_equal_all_pairs_in_small_blocks(spark, monkeypatch, threshold):
    monkeypatch.setattr(setjoin, "BLOCK", 7)
    monkeypatch.setattr(setjoin, "CHUNK", 3)
    r = random.Random(6)
    texts = ["", " ", "ab", "AB ", "日本", "日本語テキスト 日本語", "日本語テキスト 日本語!"]
    for _ in range(12):
        words = ["".join(r.choice("abcdé日\U0001f600") for _ in range(r.randrange(2, 6))) for _ in range(r.randrange(8, 60))]
        for _ in range(r.randrange(1, 9)):
            texts.append(" ".join(words))
            words[r.randrange(len(words))] = "x" * r.randrange(1, 4)
    texts = list(dict.fromkeys(texts))
    r.shuffle(texts)
    sets = [shingles(t) for t in texts]
    want = {(i, j): len(a & sets[j]) / len(a | sets[j]) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if len(a & sets[j]) / len(a | sets[j]) >= threshold}
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts[:9])] + [(3, texts[3]), (None, texts[0])]
    got = {(p.a, p.b): p.similarity for p in neardup.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), threshold).collect()}
    assert got == want and len(want) >= 1


def test_shuffles_less_than_the_texts(spark, tmp_path):
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    docs = spark.createDataFrame([(i, "".join(r.choices(letters, k=4000))) for i in range(800)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    before = shuffled(spark)
    assert neardup.near_pairs(spark.read.parquet(str(tmp_path / "d"))).count() == 0
    assert shuffled(spark) - before < 800 * 4000
