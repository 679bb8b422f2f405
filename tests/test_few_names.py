"""Few names are compared with all, many meet by rare trigrams; both find the same."""

import numpy as np
import pytest
import xxhash

from emberline.functions import embed
from emberline.operators import trigram


@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_both_ways_find_the_same(spark, monkeypatch, threshold):
    known = spark.createDataFrame([(x,) for x in ["Customer#1", "Customer#12", "customer 1", "Supplier#1", "sup", "", None, "!!", "Fräulein Öl", "France", "Frankfurt", "Frances F", "a"]], "name string")
    asked = spark.createDataFrame([(x,) for x in ["Customer", "France", "Supplier 1", None, "?", "a", "France"]], "name string")
    found = lambda: sorted((r.q, r.name, round(r.similarity, 9)) for r in trigram.similar_names(asked, known, threshold).collect())
    few = found()
    called = []
    real = trigram.candidates
    monkeypatch.setattr(trigram, "candidates", lambda *a: called.append(1) or real(*a))
    assert found() == few and not called  # before, few names went by ordered prefixes of every known name
    monkeypatch.setattr(trigram, "FEW", 2)
    assert found() == few and called and few
    monkeypatch.undo()
    assert trigram.similar_names(asked.limit(0), known, threshold).count() == 0


def test_vectors_are_those_of_single_grams():
    """The counts in one step equal one gram after the other."""
    texts = ["Customer#000000007", "", "  ", "ab", "Öl und  Öl", "x" * 300]
    want = np.zeros((len(texts), embed.DIM), np.float32)
    for row, text in zip(want, texts, strict=True):
        plain = f"  {' '.join(text.lower().split())} "
        for g in [xxhash.xxh64_intdigest(plain[i : i + 3]) for i in range(len(plain) - 2)] if plain.strip() else []:
            row[g % embed.DIM] += 1.0 if g >> 63 else -1.0
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert np.array_equal(embed.hashed(texts), want) and embed.hashed([]).shape == (0, embed.DIM)
