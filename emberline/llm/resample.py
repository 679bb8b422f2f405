"""Target-distribution importance resampling: array-scored weights, sorted runs, tournament merges.

Features are runs of one to three words, hashed into buckets. A bucket's gain is the logarithm of how much likelier the
target makes it than the documents do; a document's weight is the sum of the gains of its features, read from one array.
Gumbel noise, drawn from the doc_id, turns the highest scores into a draw without replacement in proportion to the
weights' exponentials.

The draw is exact and no task sees all of it. Every partition of the scored table is one sorted run, stored as blocks
that each lie in one range of scores. Splitters come from a bounded sample of the keys, which decides only how even the ranges are.
Exact sizes of the ranges give each one its first rank; a range's slices of all runs are merged by a tournament tree
until the draw is complete, and ranges behind the last drawn rank are not merged at all. Equal rows of a run are one
entry with a count.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import only, texts
from emberline.session import scratch, stored

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
RANGE, RANGES, PER_RANGE = 1 << 17, 4096, 16  # entries a range should hold, the most ranges, sampled keys a range
BLOCK = 4096
#: A-Z in lower case; ASCII other than letters and digits parts words, all other bytes belong to them.
_FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes) -> tuple[int, np.ndarray]:
    """The number of words, and the crc32 of every run of one to three of them; a run's crc continues that of its beginning."""
    words = text.translate(_FOLD).split()
    one = list(map(crc32, words))
    two = list(map(crc32, words[1:], map(crc32, repeat(b" "), one)))
    three = map(crc32, words[2:], map(crc32, repeat(b" "), two))
    n = len(words)
    return n, np.fromiter(chain(one, two, three), np.int64, n + max(n - 1, 0) + max(n - 2, 0))


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all texts fall into each bucket; a task sends one number a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in texts(batch):
                total += np.bincount(features(text)[1] % buckets, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    found = only(rows, "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, with one added to every count."""
    size, a, b = len(have), float(have.sum() + len(have)), float(want.sum() + len(want))
    return np.array([math.floor(1000 * math.log((float(want[i]) + 1) * a / ((float(have[i]) + 1) * b))) for i in range(size)], np.int64)


def _noise(doc_id: str | None, seed: int) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, weights, scores = [], [], [], []
            for text, i in zip(texts(batch), batch.column(0).cast(pa.string()).to_pylist(), strict=True):
                n, found = features(text)
                words.append(n)
                sizes.append(len(found))
                weights.append(int(gain[found % len(gain)].sum()))
                scores.append(weights[-1] + _noise(i, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, sizes, weights, scores))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def _key(score, doc_id, n_features) -> tuple:
    """The order of the draw: higher scores, then smaller ids (null before all), then fewer features."""
    return (-score, (0,) if doc_id is None else (1, doc_id), n_features)


class Tournament:
    """A tree of losers over the heads of sorted runs: the next entry costs one match a level."""

    def __init__(self, runs: list[Iterator]):
        self.runs, k = runs, 1
        while k < len(runs):
            k *= 2
        self.heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
        self.losers, winners = [0] * k, [0] * k + list(range(k))
        for at in range(k - 1, 0, -1):
            a, b = winners[2 * at], winners[2 * at + 1]
            winners[at], self.losers[at] = (a, b) if self._first(a, b) else (b, a)
        self.best = winners[1] if k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def __iter__(self) -> Iterator:
        k = len(self.heads)
        while self.heads[self.best] is not None:
            yield self.heads[self.best]
            self.heads[self.best] = next(self.runs[self.best], None)
            at, best = (self.best + k) // 2, self.best
            while at:
                if self._first(self.losers[at], best):
                    best, self.losers[at] = self.losers[at], best
                at //= 2
            self.best = best


def _blocks(splitters: list[tuple], kind: T.DataType):
    """Cuts each partition, which is a sorted run, into blocks of one range each; equal neighbours become one entry."""
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # range, run, score, id, features, weight, copies
        keys = ["doc_id", "n_features", "weight", "score", "run"]

        def block() -> pa.RecordBatch:
            cols = [[x[i] for x in held] for i in range(2, 7)]
            part, number = held[0][0], held[0][1]
            lists = [pa.array([cols[0]], pa.list_(pa.int64())), pa.array([cols[1]], pa.list_(arrow or pa.string())), *(pa.array([c], pa.list_(pa.int64())) for c in cols[2:])]
            out = [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([sum(cols[4])], pa.int64()), *lists]
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["part", "run", "entries", "scores", "ids", "sizes", "weights", "copies"])

        for batch in batches:
            for i, n, w, s, r in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True):
                if held and held[-1][2:6] == [s, i, n, w]:
                    held[-1][6] += 1
                    continue
                part = bisect_left(splitters, _key(s, i, n))
                if held and (part != held[0][0] or len(held) >= BLOCK):
                    yield block()
                held.append([part, r, s, i, n, w, 1])
        if held:
            yield block()

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, range_size: int = RANGE) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text); rank is null where it is not drawn.

    Of the rows with ``least_words`` words or more, floor(percent / 100) of their number are drawn, by highest score, ties to
    the smaller doc_id. Null and empty texts have no features and the weight 0. A null doc_id counts as the empty
    text for its noise and comes first among ties. Repeated rows are drawn one by one, each with a rank of its own. Empty tables give no rows; without
    a target text all gains come from the added ones. Further columns of the inputs are not looked at.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    with scratch(spark) as own:
        gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
        scored = stored(weigh(docs, gain, seed), "weighed")
        able = scored.filter(F.col("n_words") >= least_words)
        share = min(1.0, percent / 100 * 1.05 + 0.001)
        n, cut = able.agg(F.count(F.lit(1)), F.percentile_approx("score", F.lit(1 - share), F.lit(10_000))).first()
        draw = percent * n // 100
        out = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("n_features", "weight", "score", "rank"))])
        rest = scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
        if not n:
            return own.result(rest, "drawn")
        # splitters: every PER_RANGE-th of a bounded sample of the keys above the cut, which lies below the last drawn score
        ranges = max(1, min(RANGES, -(-draw // range_size)))
        sample = able.filter(F.col("score") >= cut).select("score", "doc_id", "n_features").orderBy(F.xxhash64("doc_id", "score"), "doc_id", "score").limit(PER_RANGE * ranges)
        keys = sorted(_key(*row) for row in sample.collect())
        splitters = [*keys[PER_RANGE - 1 : -1 : PER_RANGE], _key(cut, None, -1)] if ranges > 1 else [_key(cut, None, -1)]
        splitters = sorted(set(splitters))

        sorted_runs = able.select("doc_id", "n_features", "weight", "score", F.spark_partition_id().cast("long").alias("run"))
        sorted_runs = sorted_runs.sortWithinPartitions(F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "weight")
        id_kind = kind.simpleString() if kind.simpleString() in ("bigint", "int") else "string"
        shape = f"part int, run long, entries long, scores array<long>, ids array<{id_kind}>, sizes array<long>, weights array<long>, copies array<long>"
        runs = stored(sorted_runs.mapInArrow(_blocks(splitters, kind), shape), "runs")

        first, at = {}, 0  # the rows before each range: as many numbers as there are ranges
        for row in runs.groupBy("part").agg(F.sum("entries").alias("m")).orderBy("part").collect():
            first[row["part"]] = at
            at += row["m"]
        last = max((p for p, before in first.items() if before < draw), default=-1)

        def merged(table: pa.Table) -> pa.Table:
            part = table["part"][0].as_py()
            left = draw - first[part]
            slices: dict[int, list] = {}
            for row in table.select(["run", "scores", "ids", "sizes", "weights", "copies"]).to_pylist():
                slices.setdefault(row["run"], []).append(list(zip(row["scores"], row["ids"], row["sizes"], row["weights"], row["copies"], strict=True)))
            by_key = [sorted(blocks, key=lambda b: _key(*b[0][:3])) for _, blocks in sorted(slices.items())]
            heads = [((_key(*x[:3]), x) for block in blocks for x in block) for blocks in by_key]
            found, given = [], 0
            for _, (s, i, size, w, m) in Tournament(heads):
                drawn = min(m, left - given)
                found.append((i, size, w, s, first[part] + given + 1, drawn, m - drawn))
                given += drawn
                if given == left:
                    break
            # what the tree still holds, and what it never reached, is not drawn
            taken = {}
            for i, size, w, s, *_ in found:
                taken[(s, i, size, w)] = taken.get((s, i, size, w), 0) + 1
            for block in chain.from_iterable(by_key):
                for s, i, size, w, m in block:
                    if taken.get((s, i, size, w)):
                        taken[(s, i, size, w)] -= 1
                    else:
                        found.append((i, size, w, s, None, 0, m))
            cols = list(zip(*found, strict=True))
            types = [table["ids"].type.value_type, *[pa.int64()] * 6]
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_features", "weight", "score", "rank", "drawn", "left"])

        columns = ["doc_id", "n_features", "weight", "score"]
        ranked = runs.filter(F.col("part") <= last).groupBy("part").applyInArrow(merged, f"doc_id {id_kind}, n_features long, weight long, score long, rank long, drawn long, left long")
        each = F.concat(
            F.when(F.col("drawn") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1), lambda k: F.col("rank") + k)).otherwise(F.array().cast("array<long>")),
            F.array_repeat(F.lit(None).cast("long"), F.col("left").cast("int")),
        )
        ranked = ranked.select(*columns, F.explode(each).alias("rank"))
        entry = F.explode(F.arrays_zip("ids", "sizes", "weights", "scores", "copies")).alias("x")
        behind = runs.filter(F.col("part") > last).select(entry).select(F.col("x.ids").alias("doc_id"), F.col("x.sizes").alias("n_features"), F.col("x.weights").alias("weight"), F.col("x.scores").alias("score"), F.explode(F.array_repeat(F.lit(None).cast("long"), F.col("x.copies").cast("int"))).alias("rank"))
        every = ranked.unionByName(behind).withColumn("doc_id", F.col("doc_id").cast(kind)).unionByName(rest)
        return own.result(every.select(*[F.col(f.name).cast(f.dataType) for f in out.fields]), "drawn")
