"""Near-duplicate pairs by MinHash signatures and bands, with the exact similarity deciding.

A signature is, for each of the permutations, the smallest hash of a text's shingles. Texts that agree in all rows of a band are candidates;
a pair of similarity s is one with probability 1 - (1 - s ** rows) ** bands: at 0.85 that is 0.99 with 16 bands of
8 rows, and 0.46 with 8 bands of 16. Equal texts are one node, so copies never form pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.names import char_shingles
from emberline.operators import setjoin
from emberline.session import scratch

BANDS, ROWS = 16, 8
PIECE = 2048
GROUP = 1 << 22  # code points of texts whose shingles are hashed together
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED, _EIGHT = np.uint64(42), np.uint64(8)


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """(node, s): the hashed k-character shingles of every different text, by its smallest doc_id; a null text counts as empty."""
    rows = docs.select(docs["doc_id"].alias("node"), F.coalesce(docs["text"], F.lit("")).alias("text")).filter("node IS NOT NULL")
    rows = rows.groupBy(F.sha2("text", 256).alias("_h")).agg(F.min_by("text", "node").alias("text"), F.min("node").alias("node"))
    return rows.select("node", F.array_distinct(F.transform(char_shingles(F.col("text"), k), lambda x: F.xxhash64(x))).alias("s"))


def _finished(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The last steps of XXH64 in place; ``y`` is room of the same shape. Arrays that stay in the cache, and no new ones, are what makes this fast."""
    for shift, factor in ((33, _P2), (29, _P3), (32, None)):
        np.right_shift(x, np.uint64(shift), out=y)
        np.bitwise_xor(x, y, out=x)
        if factor is not None:
            np.multiply(x, factor, out=x)
    return x


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """rotl(x, 27) * P1 + P4, finished, in place."""
    np.right_shift(x, np.uint64(37), out=y)
    np.left_shift(x, np.uint64(27), out=x)
    np.bitwise_or(x, y, out=x)
    np.multiply(x, _P1, out=x)
    np.add(x, _P4, out=x)
    return _finished(x, y)


def _turned(x: np.ndarray) -> np.ndarray:
    """rotl(x * P2, 31) * P1."""
    x = x * _P2
    return (x << np.uint64(31) | x >> np.uint64(33)) * _P1


def _permuted(hashes: np.ndarray, first: int, count: int) -> Iterator[np.ndarray]:
    """For each of ``count`` permutations from ``first`` what Spark's ``xxhash64(hash, number)`` gives; the array is used again for the next one."""
    seeds, out, y = _SEED + _P5 + _EIGHT ^ _turned(hashes), np.empty(len(hashes), np.uint64), np.empty(PIECE, np.uint64)
    for at in range(0, len(seeds), PIECE):
        part = seeds[at : at + PIECE]
        _mixed(part, y[: len(part)])
        part += _P5 + _EIGHT
    for salt in _turned(np.arange(first, first + count).astype(np.uint64)):
        for at in range(0, len(seeds), PIECE):
            part = out[at : at + PIECE]
            np.bitwise_xor(seeds[at : at + PIECE], salt, out=part)
            _mixed(part, y[: len(part)])
        yield out.view(np.int64)


def minima(hashes: np.ndarray, which: np.ndarray, starts: np.ndarray, first: int, count: int) -> np.ndarray:
    """(set, permutation): the smallest permuted hash of each set; ``which`` are places in ``hashes``, one set behind the other, ``starts`` where each begins.

    A shingle is permuted once however many sets it is in, which are many: texts share most of theirs.
    """
    least, held = np.empty((len(starts), count), np.int64), np.empty(len(which), np.int64)
    for r, permuted in enumerate(_permuted(hashes, first, count)):
        np.take(permuted, which, out=held, mode="clip")
        least[:, r] = np.minimum.reduceat(held, starts)
    return least


def shingle_places(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, which, starts) as ``minima`` takes them, of the k-shingles of texts: XXH64 of each different shingle's UTF-8 bytes, computed once.

    A text of fewer than ``k`` code points is one shingle.
    """
    whole, sizes = "".join(texts), np.array([len(t) for t in texts])
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    letters, kinds = (np.cumsum(seen) - 1)[points], int(seen.sum())
    long = np.flatnonzero(sizes >= k)
    counts = sizes[long] - k + 1
    begins = (np.cumsum(sizes) - sizes)[long]
    place = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    codes, most = letters[place], kinds
    for i in range(1, k):
        if most * kinds >= 1 << 62:  # numbers of what was found so far are small again
            codes = pd.factorize(codes)[0].astype(np.int64)
            most = int(codes.max(initial=0)) + 1
        codes, most = codes * kinds + letters[place + i], most * kinds
    number, found = pd.factorize(codes)
    at = np.empty(len(found), np.int64)
    at[number] = place
    hashes = [xxhash.xxh64_intdigest(whole[i : i + k].encode(), 42) for i in at.tolist()]
    pairs = np.sort(np.repeat(long, counts) * max(len(found), 1) + number)
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    short = np.flatnonzero(sizes < k)
    hashes += [xxhash.xxh64_intdigest(texts[i].encode(), 42) for i in short]
    owner = np.concatenate([pairs // max(len(found), 1), short])
    which = np.concatenate([pairs % max(len(found), 1), len(found) + np.arange(len(short))])
    order = np.argsort(owner, kind="stable") if len(short) else slice(None)
    owner, which = owner[order], which[order]
    return np.array(hashes, np.uint64), which, np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))


def band_keys(codes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key a band, the hash of its minima; 32-bit permutations, which take a twentieth of the time of those of ``signatures``."""
    odd, add = np.random.default_rng(42).integers(0, 2**32, (2, bands * rows), dtype=np.uint32)
    odd |= np.uint32(1)
    high, least = (codes * _P1 >> np.uint64(32)).astype(np.uint32), np.full(bands * rows, 2**32 - 1, np.uint32)
    for at in range(0, len(high), 256):
        np.minimum(least, (high[at : at + 256, None] * odd + add).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)], np.uint64).view(np.int64)


def signatures(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, band, minima): ``rows`` smallest hashes a band, over the shingles of (node, s).

    A task permutes the different shingles of some sets together: neither shingles nor partial minima are shuffled.
    """
    kind = sets.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                which, hashes = pd.factorize(part.column(1).flatten().to_numpy())
                sizes = pc.list_value_length(part.column(1)).to_numpy()
                flat = minima(hashes.view(np.uint64), which, np.cumsum(sizes) - sizes, 0, bands * rows).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, rows), pa.int32()), pa.array(flat))
                number = np.tile(np.arange(bands, dtype=np.int32), part.num_rows)
                nodes = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), bands)))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(number), lists], ["node", "band", "minima"])

    return sets.select("node", "s").filter(F.size("s") > 0).mapInArrow(run, f"node {kind}, band int, minima array<long>")


def text_signatures(docs: DataFrame, k: int = 5, count: int = BANDS * ROWS) -> DataFrame:
    """(node, minima): what ``signatures`` gives in one band for ``shingle_sets`` of (doc_id, text), without sets that Spark makes.

    Copies are found by their digests, after the signature: what is shuffled is signatures, never texts.
    """
    rows = docs.select(docs["doc_id"].alias("node"), setjoin.digest(docs["text"]).alias("h"), setjoin.folded(docs["text"]).alias("t")).filter("node IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = 0
            while read < b.num_rows:
                texts, size = [], 0
                while read + len(texts) < b.num_rows and size < GROUP:
                    texts.append(b.column(2)[read + len(texts)].as_py())
                    size += len(texts[-1])
                flat = minima(*shingle_places(texts, k), 0, count).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, count), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(read, len(texts)), b.column(1).slice(read, len(texts)), lists], ["node", "h", "minima"])
                read += len(texts)

    kind = rows.schema["node"].dataType.simpleString()
    found = rows.mapInArrow(run, f"node {kind}, h binary, minima array<long>")
    return found.groupBy("h").agg(F.min("node").alias("node"), F.first("minima").alias("minima")).select("node", "minima")


def whole(banded: DataFrame) -> DataFrame:
    """(node, signature): the bands of each node put together."""
    ordered = F.array_sort(F.collect_list(F.struct("band", "minima")))
    return banded.groupBy("node").agg(F.flatten(F.transform(ordered, lambda x: x["minima"])).alias("signature"))


def candidates(banded: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes that share a band."""
    keyed = banded.select("node", "band", F.xxhash64("minima").alias("key"))
    left, right = keyed.withColumnRenamed("node", "a"), keyed.withColumnRenamed("node", "b")
    return left.join(right, ["band", "key"]).filter("a < b").select("a", "b").distinct()


def close_candidates(sets: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links between candidates whose bitmaps may reach ``threshold``; a star a key would tie what is not alike.

    ``sets`` (num, n, bits) as ``setjoin.prints`` gives them, ``keyed`` (num, band, key). Keys of many sets are dealt out as pairs of blocks.
    """
    sizes = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    dealt = keyed.join(sizes.select("band", "key", F.ceil(F.col("k") / setjoin.CHUNK).cast("int").alias("m")), ["band", "key"]).join(sets.select("num", "n", "bits"), "num")
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("num"), F.col("m")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("band", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).alias("side"), "num", "n", "bits")

    def links(t: pa.Table) -> pa.Table:
        num, n, side = (t.column(x).to_numpy() for x in ("num", "n", "side"))
        own = t.column("i")[0] == t.column("j")[0]
        left, right = (np.arange(len(n)), None) if own else (np.flatnonzero(~side), np.flatnonzero(side))
        return setjoin.forest(num, setjoin.close_rows(n, setjoin.words(t.column("bits")), left, right, threshold))

    order = ["band", "key", "i", "j"]
    where = F.xxhash64(*order).alias("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            names = np.stack([t.column(c).to_numpy() for c in order])
            cuts = np.append(0, np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    yield from links(t.slice(lo, hi - lo)).to_batches()
            held = t.slice(cuts[-1]) if t.num_rows else None
        if held is not None and held.num_rows > 1:
            yield from links(held).to_batches()

    dealt = dealt.withColumn("at", where).repartition("at").sortWithinPartitions("at", *order).select(*order, "side", "num", "n", "bits")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_pairs(docs: DataFrame, threshold: float = 0.85, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, similarity), a < b: pairs of different texts whose shingles have a Jaccard similarity of ``threshold`` or more.

    Candidates share a band; all pairs of what they connect are decided, so the links of one candidate may lead to more.
    """
    with scratch(docs.sparkSession) as own:
        sets = setjoin.prints(docs, k, partial(band_keys, bands=bands, rows=rows))
        keyed = sets.select("num", F.posexplode("keys").alias("band", "key"))
        links = close_candidates(sets, keyed, threshold)
        return own.result(setjoin.pairs_inside(docs, sets, links, threshold, k), "near")
