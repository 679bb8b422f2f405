"""Near-duplicates by the exact Jaccard similarity of word shingles.

Candidates come from SimHash fingerprints of the shingle sets, linked at ``RADIUS`` or fewer differing bits, and from banded MinHash, as
fingerprints of 64 bits do not meet at every pair that is wanted: ``BANDS`` keys of ``ROWS`` minima each, so a pair at similarity 0.8 shares no key
with a probability of (1 - 0.8 ** ROWS) ** BANDS, under 1 in a billion. Documents that share a key are joined into
clusters by a star a key, never by pairs. Within a cluster, where a document's shingles come once, pairs are found by
prefix filtering, rarest shingles first, and decided by the exact similarity; pairs that are already connected are
skipped. Clusters of many shingles are dealt out as pairs of chunks, so no task holds an unbounded one and none is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import only, texts
from emberline.llm.simhash import fingerprint, link_fingerprints, shingle_hashes
from emberline.operators.components import connected_components
from emberline.session import scratch, small_batches, stored

BANDS, ROWS = 40, 4
#: Differing bits at which two fingerprints of shingle sets are candidates.
RADIUS = 3
#: A chunk of a cluster: so many documents and so many shingles, about.
CHUNK, CHUNK_SHINGLES = 2048, 1 << 20
_ODD, _ADD = np.random.default_rng(42).integers(0, 2**32, (2, BANDS * ROWS), dtype=np.uint32)
_ODD |= np.uint32(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The different shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, words)[0])


def _named(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set."""
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def band_keys(s: np.ndarray) -> np.ndarray:
    """The band keys of a shingle set; of the empty one: none."""
    if not len(s):
        return np.empty(0, np.int64)
    high, least = (s >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(high), 256):
        np.minimum(least, (high[at : at + 256, None] * _ODD + _ADD).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def linked_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of the sets the number of its component over all pairs of Jaccard ``similarity`` or more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    root = np.arange(n)
    _, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    ends = np.cumsum(sizes)
    ranked = [np.sort(rank[inverse[e - k : e]]) for e, k in zip(ends, sizes, strict=True)]
    prefix = [r[: k - int(np.ceil(similarity * k - 1e-9)) + 1] for r, k in zip(ranked, sizes, strict=True)]
    keys = np.concatenate([prefix[i] for i in order])
    rows = np.repeat(np.arange(n), [len(prefix[i]) for i in order])  # places in order of size
    by = np.argsort(keys, kind="stable")
    keys, rows = keys[by], rows[by]
    for place, i in enumerate(order):
        lo, hi = np.searchsorted(keys, prefix[i], "left"), np.searchsorted(keys, prefix[i], "right")
        met = [rows[a : a + np.searchsorted(rows[a:b], place)] for a, b in zip(lo, hi, strict=True) if b - a > 1]
        if not met:
            continue
        others = order[np.unique(np.concatenate(met))]
        others = others[sizes[others] >= similarity * sizes[i] - 1e-9]
        while len(others := others[root[others] != root[i]]):
            j, others = others[0], others[1:]
            both = len(np.intersect1d(ranked[i], ranked[j], assume_unique=True))
            if both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9:
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
    return root


def _prints(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words) for text in texts(batch)]
            a, b = zip(*map(_named, sets), strict=True) if sets else ((), ())
            columns = [batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ha", "hb", "n", "bands", "fp"])

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ha long, hb long, n long, bands array<long>, fp long")


def _members(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, text, ha, hb, cluster, m) -> (node, cluster, m, s): shingles of the rows whose text has the named set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words) for text in texts(batch)]
            names = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            own = [i for i, (s, name) in enumerate(zip(sets, names, strict=True)) if _named(s) == name]
            held = batch.take(pa.array(own, pa.int64()))
            columns = [held.column(0), held.column(4), held.column(5), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "cluster", "m", "s"])

    return rows.select("doc_id", "text", "ha", "hb", "cluster", "m").mapInArrow(run, "node long, cluster long, m int, s array<long>")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs`` (doc_id long, text).

    Documents link where the Jaccard similarity of their sets of ``words``-word shingles is ``similarity`` or more; a
    shorter text is one shingle, and texts without words are equal. component_id is the smallest doc_id reachable
    over links. Repeated rows are kept. A row without a doc_id takes no part and has a null component_id.
    """
    with scratch(docs.sparkSession) as own, small_batches(docs.sparkSession):
        prints = stored(_prints(docs, words), "shingle-prints")
        groups = prints.filter("doc_id IS NOT NULL").groupBy("ha", "hb").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
        groups = stored(groups, "sets")
        # nodes are sets, named by their smallest doc_id; one doc_id may have several texts, whose sets are then one node
        keyed = groups.select("node", F.explode("bands").alias("key"))
        least = keyed.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("w")).filter("v != w").select("key", "v")
        stars = keyed.join(least, "key").filter("node != v").select(F.col("node").alias("u"), "v").distinct()
        # fingerprints by their smallest node: sets of one fingerprint link to it, different ones within the radius to each other
        prints64 = stored(groups.filter("n > 0").groupBy("fp").agg(F.min("node").alias("v")), "fingerprints")
        same = groups.filter("n > 0").join(prints64, "fp").filter("node != v").select(F.col("node").alias("u"), "v").distinct()
        close = link_fingerprints(prints64.select(F.col("v").alias("node"), "fp", F.lit(0).cast("long").alias("size")), RADIUS)
        stars = stars.unionByName(same).unionByName(close.filter("u != v"))
        clusters = stored(connected_components(stars).select("node", F.col("component").alias("cluster")), "clusters")
        held = groups.select("node", "ha", "hb", "n").join(clusters, "node")
        sizes = held.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("m"))
        held = held.join(sizes, "cluster")
        rows = only(docs, "doc_id", "text").join(held.withColumnRenamed("node", "doc_id"), "doc_id")
        members = _members(rows, words).withColumn("c", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
        members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        members = members.select("cluster", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "node", "s")

        def links(table: pa.Table) -> pa.Table:
            nodes = table.column("node").to_numpy()
            s = table.column("s").combine_chunks()
            s = s.combine_chunks() if isinstance(s, pa.ChunkedArray) else s
            flat, offsets = s.values.to_numpy(zero_copy_only=False), s.offsets.to_numpy()
            root = linked_sets([flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], similarity)
            tied = np.flatnonzero(nodes[root] != nodes)
            return pa.table({"u": pa.array(nodes[tied], pa.int64()), "v": pa.array(nodes[root[tied]], pa.int64())})

        found = members.groupBy("cluster", "i", "j").applyInArrow(links, "u long, v long").distinct()
        tied = connected_components(found)
        named = groups.select("ha", "hb", "node").join(tied, "node", "left").select("ha", "hb", F.coalesce("component", "node").alias("component_id"))
        found = prints.select("doc_id", "ha", "hb").join(named, ["ha", "hb"], "left")
        return own.result(found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")), "near")
