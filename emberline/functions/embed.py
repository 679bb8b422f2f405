"""Texts as vectors: a pluggable embedding, by default hashed character n-grams, which needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

DIM = 384


def hashed(texts: list[str], dim: int = DIM, n: int = 3) -> np.ndarray:
    """One row a text: counts of its hashed n-grams, with signs, scaled to length 1; an empty text is all zeros."""
    grams, counts = [], []
    for text in texts:
        plain = f"  {' '.join(text.lower().split())} "
        found = [xxhash.xxh64_intdigest(plain[i : i + n]) for i in range(len(plain) - n + 1)] if plain.strip() else []
        grams += found
        counts.append(len(found))
    g = np.array(grams, np.uint64)
    at = np.repeat(np.arange(len(texts)) * dim, counts) + (g % np.uint64(dim)).astype(np.int64)
    out = np.bincount(at, np.where(g >> np.uint64(63), 1.0, -1.0), len(texts) * dim).astype(np.float32).reshape(len(texts), dim)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], np.ndarray] = hashed, batch: int = 64) -> DataFrame:
    """(key, embedding) of every row, ``batch`` texts at a time; a null text counts as empty."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                vectors = np.asarray(embed([x or "" for x in part.column(1).to_pylist()]), np.float32)
                ends = pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], [key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")
