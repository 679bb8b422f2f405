"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared within blocks. A block's fingerprints are stored vertically: plane b holds bit b
of 64 neighbours per machine word. Comparing every row with the row d places further takes one XOR a plane;
carry-save counters add the differing bits of 64 pairs at once, and words whose 64 pairs have all passed the
radius are abandoned. Blocks come from the pigeonhole principle: cut into radius + 1 fields, two fingerprints
within the radius agree in one field at least, so none is lost.

Fields shared by very many distinct fingerprints are dealt out as pairs of chunks of ``chunk`` rows, so no
task holds an unbounded block and none is capped. Within a block only a spanning forest of its links leaves
the task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import only, texts
from emberline.operators.components import connected_components
from emberline.session import scratch, stored

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, n: int) -> tuple[np.ndarray, int]:
    """XXH64 (seed 42) of every n-word shingle of the lower-cased text, and the number of words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64), 0
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64), len(words)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes; of none: 0."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long, n_words long) of every row of ``docs`` (doc_id, text), repeated rows included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, counts = [], []
            for text in texts(batch):
                hashes, n = shingle_hashes(text, words)
                fps.append(fingerprint(hashes))
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(counts, pa.int64())], ["doc_id", "fp", "n_words"]
            )

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long, n_words long")


class _Planes:
    """The bit planes of a run of fingerprints, with the planes shifted by d rows on demand."""

    def __init__(self, fps: np.ndarray):
        bits = np.unpackbits(fps.astype("<u8").view(np.uint8), bitorder="little").reshape(len(fps), 64)
        self.n_words = (len(fps) + 63) // 64
        padded = np.zeros((64, (self.n_words + 1) * 64), np.uint8)
        padded[:, : len(fps)] = bits.T
        self.planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")

    def differing(self, plane: int, at: np.ndarray, d: int) -> np.ndarray:
        """Bit j of word w: whether rows 64w + j and 64w + j + d differ in this plane."""
        p, q, r = self.planes[plane], d // 64, np.uint64(d % 64)
        low, last = np.minimum(at + q, self.n_words), np.minimum(at + q + 1, self.n_words)
        moved = p[low] if r == 0 else (p[low] >> r) | (p[last] << (np.uint64(64) - r))
        return p[at] ^ moved


def linked_at(planes: _Planes, same: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Rows i whose fingerprint is within ``radius`` bits of row i + d; ``same``: whether both are of one block."""
    packed = np.zeros(planes.n_words * 8, np.uint8)
    flat = np.packbits(same, bitorder="little")
    packed[: len(flat)] = flat
    alive = packed.view("<u8")
    at = np.flatnonzero(alive)
    alive = alive[at]
    k = radius.bit_length() if radius else 1
    start = (1 << k) - 1 - radius  # the counters overflow exactly when the distance passes the radius
    counters = [np.full(len(at), ONES if start >> i & 1 else 0, np.uint64) for i in range(k)]
    for plane in range(64):
        carry = planes.differing(plane, at, d)
        for i in range(k):
            carry, counters[i] = counters[i] & carry, counters[i] ^ carry
        alive = alive & ~carry
        if plane % 8 == 7 or plane < 8 and plane % 4 == 3:
            keep = np.flatnonzero(alive)
            if len(keep) < len(at):
                at, alive, counters = at[keep], alive[keep], [c[keep] for c in counters]
            if not len(at):
                return at
    rows, bits = np.nonzero(np.unpackbits(alive.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
    return at[rows] * 64 + bits


def spanning_links(block: np.ndarray, fps: np.ndarray, sizes: np.ndarray, radius: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (u, v) of a spanning forest of the links within each block. ``block``: sorted block numbers, one a row."""
    n = len(fps)
    ends = np.append(np.flatnonzero(np.diff(block)) + 1, n)
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n) - 1  # rows of the same block that follow
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    planes, d = _Planes(fps), 1
    while (same := left >= d).any():
        i = linked_at(planes, same, d, radius)
        if len(i) and ratio > 0:
            a, b = sizes[i], sizes[i + d]
            i = i[np.minimum(a, b) >= ratio * np.maximum(a, b)]
        for a in i[root[i] != root[i + d]].tolist():
            x, y = find(a), find(a + d)
            if x != y:
                root[max(x, y)] = min(x, y)
        while len(i) and not np.array_equal(up := root[root], root):
            root[:] = up
        d += 1
    tied = np.flatnonzero(root != np.arange(n))
    return tied, root[tied]


def link_fingerprints(fps: DataFrame, radius: int = 2, ratio: float = 0.0, chunk: int = 2048) -> DataFrame:
    """(node, fp, size), all long -> links (u, v) of nodes whose components are those of all pairs within ``radius``.

    ``ratio``: the smaller size must be at least so much of the larger (0: sizes do not matter).
    """
    fields = radius + 1
    cuts = [64 * i // fields for i in range(fields + 1)]
    field = F.array(*[F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if hi - lo < 64 else F.col("fp") for lo, hi in zip(cuts, cuts[1:], strict=False)])
    keyed = fps.select("node", "fp", "size", F.posexplode(field).alias("f", "v"))
    if ratio > 0:
        # sizes within the ratio fall into the same or neighbouring steps of a logarithmic scale
        step = F.floor(F.log(F.col("size") + 1) / F.lit(float(-np.log(ratio)) * 1.001)).cast("long")
        keyed = keyed.withColumn("s", F.explode(F.array(step, step + 1)))
    else:
        keyed = keyed.withColumn("s", F.lit(0).cast("long"))
    counts = keyed.groupBy("f", "v", "s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("m", F.ceil(F.col("n") / chunk).cast("int"))
    dealt = keyed.join(counts.select("f", "v", "s", "m"), ["f", "v", "s"])
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    dealt = dealt.withColumn("c", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    key = F.xxhash64("f", "v", "s", F.least("c", "o"), F.greatest("c", "o"))
    dealt = dealt.select(key.alias("k"), "f", "v", "s", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            changed = (rows[:-1, :6] != rows[1:, :6]).any(1)
            u, v = spanning_links(np.append(0, np.cumsum(changed)), rows[:, 6].view(np.uint64), rows[:, 7], radius, ratio)
            return pa.RecordBatch.from_arrays([pa.array(rows[u, 8]), pa.array(rows[v, 8])], ["u", "v"])

        for batch in batches:
            rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)
            held.append(rows)
            if sum(map(len, held)) < 65536:
                continue
            rows = np.concatenate(held)
            cut = np.flatnonzero((rows[:-1, :6] != rows[1:, :6]).any(1))
            if len(cut):
                yield links(rows[: cut[-1] + 1])
                rows = rows[cut[-1] + 1 :]
            held = [rows]
        if sum(map(len, held)):
            yield links(np.concatenate(held))

    order = ["k", "f", "v", "s", "i", "j", "fp"]
    return dealt.repartition("k").sortWithinPartitions(*order).mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, ratio: float = 0.0) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, fp long, n_words, component_id.

    Fingerprints link at ``radius`` or fewer differing bits; with a ``ratio`` also only where the smaller
    text has at least so much of the larger one's words. component_id is the smallest doc_id reachable over
    links, the document's own included. A null text counts as empty; empty texts have fingerprint 0 and link
    like any other. Repeated rows are kept. A row without a doc_id takes no part and has a null component_id.
    """
    with scratch(docs.sparkSession) as own:
        prints = stored(fingerprints(docs, words), "fingerprints")
        size = F.col("n_words") if ratio > 0 else F.lit(0).cast("long")
        prints = prints.withColumn("size", size)
        groups = stored(prints.filter("doc_id IS NOT NULL").groupBy("fp", "size").agg(F.min("doc_id").alias("node")), "groups")
        tied = connected_components(link_fingerprints(groups, radius, ratio))
        named = groups.join(tied, "node", "left").select("fp", "size", F.coalesce("component", "node").alias("component_id"))
        found = prints.join(named, ["fp", "size"], "left")
        return own.result(found.select("doc_id", "fp", "n_words", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")), "near")
