"""Cross-entropy difference of matched n-gram models.

A target model and a background model, of all other documents, share one vocabulary: the ``vocabulary`` most frequent
words of all documents, every other word being one unknown word. Both are bigram models, smoothed alike towards their
single words; the background's counts are scaled to the target's size, so the two are matched in order, vocabulary,
smoothing and size. A document's score is the mean over its words of background loss minus target loss.

No document is scored by a model that has seen it: texts are dealt into two halves by hash, copies together, and each
half is scored by the counts of the other.

Counts cover every document. Documents are dealt into chunks of bounded size by their ids. A chunk sends each of its different pairs
once a half, with its counts, to the part of the pair's hash; the part sums them and gives every chunk the other half's counts of what
it sent, in that order, so no pair goes back and no pair is joined to documents. What is sent grows with the chunks, as the input does,
whatever the pairs' frequencies. Only the counts of single words, of bounded number, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import only, texts
from emberline.llm.simhash import LOWER
from emberline.session import scratch, stored

VOCABULARY, HOT = 1 << 15, 1 << 20
WEIGHT, ADD = 5.0, 0.5  # of the single words in a pair's probability, and of every word in theirs
CHUNK = 1 << 21  # words that a task sums at a time
PART = 12 << 20  # bytes of input a chunk
REMEMBERED = 1 << 18  # words whose numbers a task remembers
BLOCK = 512  # words whose counts are summed together


def _half(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 7) & 1


def _hashes(text: bytes) -> np.ndarray:
    words = text.translate(LOWER).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


class _Numbers(dict):
    """Numbers of words as they are met: 1 on for those of the vocabulary, unknown words 0."""

    def __init__(self, known: np.ndarray):
        super().__init__()
        self.known = dict(zip(known.view(np.uint64).tolist(), range(1, len(known) + 1), strict=True))

    def __missing__(self, word: bytes) -> int:
        number = self.known.get(xxhash.xxh64_intdigest(word), 0)
        if len(self) < REMEMBERED:
            self[word] = number
        return number


def _pairs(texts: list[bytes], numbers: _Numbers, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every word of all texts the number of the word before it times ``base`` and its own, and how many words each text has.

    Before a text's first word is the number ``base - 1``.
    """
    found, sizes = [], []
    for k in range(0, len(texts), 512):
        split = [x.translate(LOWER).split() for x in texts[k : k + 512]]
        n = np.fromiter(map(len, split), np.int64, len(split))
        w = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        before = np.append(base - 1, w[:-1])[: len(w)]
        before[(np.cumsum(n) - n)[n > 0]] = base - 1
        found.append(before * base + w)
        sizes.append(n)
    return np.concatenate([np.empty(0, np.int64), *found]), np.concatenate([np.empty(0, np.int64), *sizes])


def _dealt(pairs: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted pairs by part, and where each part begins in it."""
    part = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    return np.argsort(part, kind="stable"), np.append(0, np.cumsum(np.bincount(part, minlength=parts)))


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """The values of lists, one behind the other."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, keys, columns: str) -> DataFrame:
    """(key, n) of the integers that ``keys`` gives for each batch, summed within a task as far as they fit; a key may come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

        for batch in batches:
            for found in keys(batch):
                held.append(found)
                size += len(found)
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return only(rows, *columns.split()).mapInArrow(run, "key long, n long")


class _Model:
    """Counts of single words by half and class, dense over the vocabulary, and the scales that match the two sizes."""

    def __init__(self, before: np.ndarray, single: np.ndarray):
        """``before``, ``single``: (half, class, word) counts as a pair's first and second word; class 1 is the target."""
        total = single.sum(2)
        self.scale = np.stack([np.where(total[:, 0] > 0, total[:, 1] / np.maximum(total[:, 0], 1), 0), np.ones(2)], 1)
        size = (total * self.scale)[:, :, None]
        self.before = before * self.scale[:, :, None]
        self.word = (single * self.scale[:, :, None] + ADD) / (size + ADD * single.shape[2])

    def gain(self, half: int, v: np.ndarray, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Background loss minus target loss of pairs by the counts (class, pair) of a half."""
        p = [(counts[c] * self.scale[half, c] + WEIGHT * self.word[half, c][w]) / (self.before[half, c][v] + WEIGHT) for c in (0, 1)]
        return np.log(p[1] / p[0])


def score(docs: DataFrame, target_ids: DataFrame, vocabulary: int = VOCABULARY, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, score) of every row of ``docs`` (doc_id, text); the target is the rows whose doc_id is in ``target_ids``.

    Words are runs of anything but ASCII space and U+0009 to U+000D, A-Z in lower case. Higher scores, in nats, are more
    like the target. Null and empty texts have 0 words and score 0; without a target or a background all scores are 0.
    Rows that share a doc_id (or have none) are scored as one document of all their words. ``hot`` has no effect any more:
    frequent and rare pairs go one way.
    """
    spark = docs.sparkSession
    with scratch(spark) as own:
        rows = only(docs, "doc_id", "text")
        counted = _summed(rows, lambda batch: map(_hashes, texts(batch)), "text").groupBy("key").agg(F.sum("n").alias("n"))
        known = np.sort(counted.orderBy(F.desc("n"), "key").limit(vocabulary).select("key").toArrow()["key"].to_numpy())
        known = known if len(known) else np.array([0], np.int64)
        base = len(known) + 2
        shared = spark.sparkContext.broadcast(known)

        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size if size < 1 << 60 else 0) // PART)  # Spark's stand-in for an unknown size is larger
        kind = docs.schema["doc_id"].dataType.simpleString()
        deal = lambda c: F.pmod(F.hash(c), F.lit(parts))
        chunks = rows.withColumn("chunk", F.when(F.col("doc_id").isNull(), deal("text")).otherwise(deal("doc_id")))
        chosen = target_ids.select(F.col("doc_id").try_cast(kind).alias("t")).filter("t IS NOT NULL").distinct().withColumn("chunk", deal("t"))
        one = pa.int32() if base * base < 1 << 31 else pa.int64()

        def sent(own: pa.Table, targets: pa.Table) -> pa.Table:
            """Of a chunk the different pairs of each half with their counts outside and inside the target, by part."""
            if not own.num_rows:
                return pa.table({"part": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "half": pa.array([], pa.int32()), "pair": pa.array([], pa.list_(one)), "n0": pa.array([], pa.list_(pa.int32())), "n1": pa.array([], pa.list_(pa.int32()))})
            some = _texts(own)
            pairs, n = _pairs(some, _Numbers(shared.value), base)
            target = np.repeat(pc.is_in(own["doc_id"], value_set=targets["t"].combine_chunks()).to_numpy(zero_copy_only=False), n)
            half, out = np.repeat([_half(x) for x in some], n), []
            for k in (0, 1):
                key, count = np.unique(pairs[half == k] * 2 + target[half == k], return_counts=True)
                pair, at = np.unique(key >> 1, return_inverse=True)
                counts = np.zeros((2, len(pair)), np.int32)
                counts[key & 1, at] = count
                order, ends = _dealt(pair, parts)
                columns = [_lists(pair[order], ends, one), *[_lists(c[order], ends, pa.int32()) for c in counts]]
                table = pa.table([pa.array(range(parts), pa.int32()), pa.array([own["chunk"][0].as_py()] * parts, pa.int32()), pa.array([k] * parts, pa.int32()), *columns], ["part", "chunk", "half", "pair", "n0", "n1"])
                out.append(table.filter(pa.array(np.diff(ends) > 0)))
            return pa.concat_tables(out)

        def answered(sent: pa.Table) -> pa.Table:
            """To every list of pairs the other half's counts; and, as chunk -1, this part's counts of first and second words, by blocks of words."""
            pair, at = np.unique(_flat(sent["pair"]).astype(np.int64), return_inverse=True)
            sizes = pc.list_value_length(sent["pair"]).to_numpy()
            row = sent["half"].to_numpy()
            half = np.repeat(row, sizes)
            counts = np.zeros((2, 2, len(pair)))
            for k in (0, 1):
                for c in (0, 1):
                    counts[k, c] = np.bincount(at[half == k], weights=_flat(sent[f"n{c}"])[half == k], minlength=len(pair))
            ends = np.append(0, np.cumsum(sizes))
            found = [_lists(counts[1 - half, c, at].astype(np.int64), ends, pa.int64()) for c in (0, 1)]
            blocks = -(-base // BLOCK)
            words = np.stack([np.bincount(w, weights=n, minlength=blocks * BLOCK) for w in (pair // base, pair % base) for n in counts.reshape(4, -1)]).astype(np.int64)
            words = words.reshape(8, blocks, BLOCK).transpose(1, 0, 2).reshape(blocks, -1)
            filled = np.flatnonzero(words.any(1))
            by_block = [pa.array([-1] * len(filled), pa.int32()), pa.array(filled, pa.int32()), pa.array([0] * len(filled), pa.int32()), _lists(words[filled].ravel(), np.arange(len(filled) + 1) * words.shape[1], pa.int64()), pa.array([[]] * len(filled), pa.list_(pa.int64()))]
            names = ["chunk", "part", "half", "c0", "c1"]
            return pa.concat_tables([pa.table([sent["chunk"], sent["part"], sent["half"], *found], names), pa.table(by_block, names)])

        columns = f"part int, chunk int, half int, pair array<{'int' if one == pa.int32() else 'bigint'}>, n0 array<int>, n1 array<int>"
        asked = chunks.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInArrow(sent, columns)
        pairs = stored(asked.groupBy("part").applyInArrow(answered, "chunk int, part int, half int, c0 array<bigint>, c1 array<bigint>"), "pairs")

        def summed(block: pa.Table) -> pa.Table:
            total = _flat(block["c0"]).reshape(block.num_rows, -1).sum(0)
            return pa.table([block["part"].slice(0, 1), _lists(total, np.array([0, len(total)]), pa.int64())], ["part", "c0"])

        dense = np.zeros((8, -(-base // BLOCK) * BLOCK))
        for row in pairs.filter("chunk < 0").select("part", "c0").groupBy("part").applyInArrow(summed, "part int, c0 array<bigint>").toArrow().to_pylist():
            dense[:, row["part"] * BLOCK : (row["part"] + 1) * BLOCK] = np.reshape(row["c0"], (8, BLOCK))
        before, single = dense[:, :base].reshape(2, 2, 2, base)
        model = spark.sparkContext.broadcast(_Model(before, single))

        def scored(own: pa.Table, answers: pa.Table) -> pa.Table:
            if not own.num_rows:
                return pa.table([own["doc_id"], pa.array([], pa.int64()), pa.array([], pa.float64())], ["doc_id", "n_words", "s"])
            some = _texts(own)
            pairs, n = _pairs(some, _Numbers(shared.value), base)
            doc, half, sums = np.repeat(np.arange(len(n)), n), np.repeat([_half(x) for x in some], n), np.zeros(len(n))
            for k in (0, 1):
                pair, at = np.unique(pairs[half == k], return_inverse=True)
                order, _ = _dealt(pair, parts)
                found = answers.filter(pc.equal(answers["half"], k)).sort_by("part")
                counts = np.stack([_flat(found["c0"]), _flat(found["c1"])]).astype(np.float64)
                if counts.shape[1] != len(pair):
                    raise RuntimeError("a chunk differs from what it was when its pairs were counted")
                other = np.empty_like(counts)
                other[:, order] = counts
                gain = model.value.gain(1 - k, pair // base, pair % base, other)
                sums += np.bincount(doc[half == k], weights=gain[at], minlength=len(n))
            return pa.table([own["doc_id"], pa.array(n, pa.int64()), pa.array(sums)], ["doc_id", "n_words", "s"])

        answers = pairs.filter("chunk >= 0")
        first = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, f"doc_id {kind}, n_words long, s double")
        whole = first.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("s").alias("s"))
        mean = F.when(F.col("n_words") > 0, F.col("s") / F.col("n_words")).otherwise(F.lit(0.0))
        return own.result(whole.select("doc_id", "n_words", mean.alias("score")))


def _texts(own: pa.Table) -> list[bytes]:
    return [x or b"" for x in own["text"].cast(pa.large_binary()).to_pylist()]
