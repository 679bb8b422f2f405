"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a model of its own with three interpolated levels: word pairs, words, and word
beginnings (the first ``STEM`` letters, so an unseen form of a known word is not unknown). A level keeps the discounted
counts of expressions that the two classes use at rates more than ``SURE`` standard deviations of chance apart, given the
level below; all other counts, rare expressions among them, are discounted whole and go to the level below, and below
the last to continuation counts (in how many contexts a word or beginning occurs) that both classes share. So an
expression that is rare in both classes weighs nothing, and one that is frequent in one class alone weighs much.

A document's evidence is the difference of its two log-likelihoods, each divided by the number of words; a logistic
curve, fitted on labelled texts that the model under test did not see (cross-fitting by text, so copies stay on one
side), makes it a score.

The models are fitted on a bounded sample: at most ``max_rows`` rows and ``max_chars`` code points of each class, in hash
order of the ids. That bounds what is broadcast. Every document is scored, whole.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import only, texts

DISCOUNT, SURE, STEM, FOLDS = 0.75, 4.0, 4, 3
MARK = "\x00"  # stands before the first word; no word of a text equals it alone
EDGE = ".,;:!?\"'()[]|*%$&#"


def tokens(text: str) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    return [w for x in text.lower().split() if (w := x.strip(EDGE))]


def sure(plain: int, toxic: int, share: float) -> bool:
    """Whether toxic of plain + toxic counts is far from the share expected by chance."""
    n = plain + toxic
    return abs(toxic - n * share) > SURE * math.sqrt(n * share * (1 - share) + 1)


def _counted(text: str) -> tuple[set, set, set]:
    """The different word pairs, words and beginnings of a text."""
    listed = [sys.intern(w) for w in tokens(text)]
    return set(zip([MARK, *listed], listed, strict=False)), set(listed), {sys.intern(w[:STEM]) for w in listed}


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(parts)) >> 1


class _Table:
    """Logarithms of ratios by 63-bit key, of few bytes each."""

    def __init__(self, values: dict[int, float]):
        self.keys = np.array(sorted(values) or [-1], np.int64)
        self.logs = np.array([values.get(k, 0.0) for k in self.keys.tolist()], np.float32)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.logs[at], 0.0), found


class Ratio:
    """log p(w | v, toxic) - log p(w | v, ordinary) of the two Kneser-Ney models.

    A text counts an expression once, so repeated lines weigh no more than single ones.
    """

    def __init__(self, some: list[tuple[int, tuple[set, set, set]]]):
        """``some``: (class, ``_counted`` text); class 1 is toxic."""
        pairs, words, stems = ([Counter(), Counter()] for _ in range(3))
        for label, (two, one, begun) in some:
            pairs[label].update(two)
            words[label].update(one)
            stems[label].update(begun)
        contexts = Counter(w for _, w in pairs[0].keys() | pairs[1].keys())  # shared continuation counts of words
        kinds: Counter = Counter()  # and of beginnings
        for w, n in contexts.items():
            kinds[w[:STEM]] += n
        every = sum(kinds.values()) or 1
        of_stem, after = {}, {}
        for k in (0, 1):
            for w, n in words[k].items():
                of_stem.setdefault(w[:STEM], [0, 0])[k] += n
            for (v, _), n in pairs[k].items():
                after.setdefault(v, [0, 0])[k] += n
        total = [sum(c.values()) for c in stems]
        share = total[1] / (sum(total) or 1)

        kept, left = self._level(stems, lambda x: None, {None: total}, lambda x: share)
        p_stem = {x: self._mixed(kept.get(x), total, left.get(None), [n / every] * 2) for x, n in kinds.items()}
        kept, left = self._level(words, lambda w: w[:STEM], of_stem, lambda w: of_stem[w[:STEM]][1] / sum(of_stem[w[:STEM]]))
        p_word = {}
        for w, n in contexts.items():
            inside = self._mixed(kept.get(w), of_stem[w[:STEM]], left.get(w[:STEM]), [n / kinds[w[:STEM]]] * 2)
            p_word[w] = [p * q for p, q in zip(p_stem[w[:STEM]], inside, strict=True)]
        unseen = {x: [q * r for q, r in zip(p, left.get(x, (1, 1)), strict=True)] for x, p in p_stem.items()}

        def odds(x: tuple[str, str]) -> float:
            a, b = (n * p for n, p in zip(after[x[0]], p_word[x[1]], strict=True))
            return b / (a + b)

        kept, left = self._level(pairs, lambda x: x[0], after, odds)
        log = lambda p: math.log(p[1] / p[0])
        self.stem = _Table({_key(MARK, x): log(p) for x, p in unseen.items()})
        self.word = _Table({_key(w): log(p) for w, p in p_word.items()})
        # a pair that is not kept is its word times the share that its context hands down
        self.context = _Table({_key(v, ""): log(p) for v, p in left.items()})
        self.pair = _Table({_key(*x): log(self._mixed(n, after[x[0]], left[x[0]], p_word[x[1]])) for x, n in kept.items()})

    @staticmethod
    def _level(counts: list[Counter], of, totals: dict, odds) -> tuple[dict, dict]:
        """What each class keeps of expressions whose counts tell the classes apart, and the share that each context hands down."""
        kept, gone = {}, {}
        for x in counts[0].keys() | counts[1].keys():
            n = counts[0][x], counts[1][x]
            if sum(n) > SURE and sure(*n, odds(x)):
                kept[x] = [max(c - DISCOUNT, 0) for c in n]
                sums = gone.setdefault(of(x), [0, 0])
                for k in (0, 1):
                    sums[k] += kept[x][k]
        return kept, {v: [1 - g / t if t else 1.0 for g, t in zip(sums, totals[v], strict=True)] for v, sums in gone.items()}

    @staticmethod
    def _mixed(own: list[float] | None, total: list[int], left: list[float] | None, lower: list[float]) -> list[float]:
        """A level's probabilities of both classes: kept counts, and what is handed down to the level below."""
        return [(o / t if t else 0.0) + d * p for o, t, d, p in zip(own or (0, 0), total, left or (1.0, 1.0), lower, strict=True)]

    def mean(self, text: str) -> float:
        """Log-likelihood a word of the toxic model less that of the ordinary one; of no words: 0."""
        words = tokens(text)
        if not words:
            return 0.0
        keys = lambda found: np.fromiter(found, np.int64, len(words))
        value, known = self.word.look(keys(map(_key, words)))
        if not known.all():
            at = np.flatnonzero(~known)
            value[at] = self.stem.look(np.fromiter((_key(MARK, words[i][:STEM]) for i in at.tolist()), np.int64, len(at)))[0]
        before = [MARK, *words[:-1]]
        value = value + self.context.look(keys(_key(v, "") for v in before))[0]
        pair, whole = self.pair.look(keys(map(_key, before, words)))
        return float(np.where(whole, pair, value).mean())


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a lightly penalised logistic regression of balanced classes, by Newton steps."""
    scale = float(np.abs(x).max()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    b = np.zeros(2)
    penalty = np.diag([1e-3, 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b = b + np.clip(np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ b), -5, 5)
    return float(max(b[0], 0.0)) / scale, float(b[1])


def learned(rows: list[tuple[int, str]]) -> tuple[Ratio, float, float]:
    """The model of (class, text) rows: ratio, slope, offset."""
    held = sorted(set(rows), key=lambda x: (xxhash.xxh64_intdigest(x[1]), x))
    counted = [(label, _counted(text)) for label, text in held]
    ratio = Ratio(counted)
    y = np.array([label for label, _ in held], float)
    if len(set(y)) < 2:
        return ratio, 0.0, 30.0 if y.sum() else -30.0
    fold = np.array([xxhash.xxh64_intdigest(t, 7) % FOLDS for _, t in held])
    x = np.zeros(len(held))
    for k in range(FOLDS):
        part = Ratio([c for c, f in zip(counted, fold, strict=True) if f != k])
        for i in np.flatnonzero(fold == k):
            x[i] = part.mean(held[i][1])
    return ratio, *_logistic(x, y)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_chars: int = 1_500_000) -> tuple[Ratio, float, float]:
    """The model of the labelled documents outside the held-out fifth: ratio, slope, offset.

    ``docs`` (doc_id, text), ``labels`` (doc_id, toxic). Of each class the first ``max_rows`` ids in hash order are
    looked up, and texts are taken in that order while ``max_chars`` code points hold them; one too long for what
    is left is passed over, of equal texts the first is taken. Null texts, null ids and other labels are not used.
    """
    known = only(labels, "doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    some = [known.filter(F.col("toxic") == k).select("doc_id", F.lit(k).alias("label")).distinct().orderBy(*order).limit(max_rows) for k in (0, 1)]
    # at most 2 * max_rows ids are broadcast, here and below
    ids = F.broadcast(some[0].unionByName(some[1]).withColumnRenamed("doc_id", "_id"))
    have = only(docs, "doc_id", "text").filter("text IS NOT NULL")
    have = have.select("doc_id", "text", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    sizes = have.join(ids, have["doc_id"] == ids["_id"]).groupBy("doc_id", "label").agg(F.min(F.struct("h", "n")).alias("t"))
    room, taken, seen = [max_chars, max_chars], [], set()
    for row in sorted(sizes.select("doc_id", "label", "t.h", "t.n").collect(), key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["label"])):
        if row["n"] <= room[row["label"]] and (row["h"], row["label"]) not in seen:
            room[row["label"]] -= row["n"]
            seen.add((row["h"], row["label"]))
            taken.append((row["doc_id"], row["h"], row["label"]))
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = F.broadcast(spark.createDataFrame(taken, f"_id {kind}, _h long, label int"))
    fetched = have.join(picked, (have["doc_id"] == picked["_id"]) & (have["h"] == picked["_h"])).groupBy("doc_id", "label").agg(F.first("text").alias("text"))
    return learned([(row["label"], row["text"]) for row in fetched.select("label", "text").collect()])


def score(docs: DataFrame, model: tuple[Ratio, float, float], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1) and a prediction (1 from 0.5 on), ``names``, in place of columns of those names.

    Every row is kept, repeated ones too. A null or empty text has the evidence 0. Other columns pass unchanged.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in names]
    kept = docs.select(*[docs[c] for c in rest])
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, a, b = shared.value
        for batch in batches:
            z = np.array([a * r.mean(t.decode("utf-8", "replace")) + b for t in texts(batch)], float)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            cols = [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*rest, *names])

    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text is a multiple of five: no label of such a row is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
