"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram of three letters is bound into one vector: the
product of its letters' vectors, each rotated by its place. A text's n-gram vectors are bundled by adding them up, and the
bundle of all texts of a language is its prototype. A document gets the language whose prototype has the largest cosine with its own bundle.

Bundles are whole numbers, so sums do not depend on their order. Counting a text's n-grams first turns
bundling into a product of matrices, in slices of bounded size; a long text is cut into pieces that share their border.
The prototypes are as many as there are languages, one vector each, and are broadcast.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import only, texts

DIMENSIONS, ORDER = 2048, 3
PIECE, SLICE, ROWS = 1 << 20, 2048, 256  # letters bundled at once, n-grams a matrix, documents a matrix
NONE = "und"


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks that stand on letters, 0 for all else, which is a gap."""
    kind = {"L": 2, "M": 1}
    return np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def letters(text: bytes) -> np.ndarray:
    """Lower-cased letters as code points, each gap one 0, with a 0 at both ends; empty without a letter."""
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    kind = _kinds()[codes]
    if not (kind == 2).any():
        return np.empty(0, np.uint32)
    codes = np.concatenate([[0], np.where(kind > 0, codes, 0), [0]]).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


class Space:
    """The letters' vectors, made when they are first met; at most ``most`` are kept."""

    def __init__(self, dimensions: int = DIMENSIONS, most: int = 1 << 14):
        self.dimensions, self.most = dimensions, most
        self.known: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        found = self.known.get(code)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[code] = np.random.default_rng([code, 12]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return found

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """One vector for each row of letters."""
        codes, at = np.unique(grams, return_inverse=True)
        every = np.stack([self.letter(int(c)) for c in codes])
        at = at.reshape(grams.shape)
        out = np.roll(every, ORDER - 1, axis=1)[at[:, 0]]
        for k in range(1, ORDER):
            out = out * np.roll(every, ORDER - 1 - k, axis=1)[at[:, k]]
        return out

    def bundles(self, pieces: Iterable[tuple[int, np.ndarray]], rows: int) -> np.ndarray:
        """The sums of n-gram vectors by row; ``pieces`` are (row, letters)."""
        out = np.zeros((rows, self.dimensions), np.int64)
        held, size = [], 0
        for row, codes in pieces:
            for at in range(0, max(len(codes) - ORDER + 1, 0), PIECE):
                part = codes[at : at + PIECE + ORDER - 1]
                if size + len(part) > PIECE and held:
                    self._add(out, held)
                    held, size = [], 0
                held.append((row, part))
                size += len(part)
        if held:
            self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
        codes = np.concatenate([c for _, c in held])
        sizes = np.array([len(c) for _, c in held])
        piece = np.repeat(np.arange(len(held)), sizes)
        inside = piece[: 1 - ORDER] == piece[ORDER - 1 :]
        met, near = np.unique(codes, return_inverse=True)
        # an n-gram is one number in the base of the letters met; a small base needs no sorting
        number = np.zeros(len(codes) - ORDER + 1, np.int64)
        for k in range(ORDER):
            number = number * len(met) + near[k : len(near) - ORDER + 1 + k]
        row = np.array([r for r, _ in held])[piece[: 1 - ORDER][inside]]
        number = number[inside]
        if len(met) ** ORDER <= 1 << 22:
            there = np.bincount(number, minlength=len(met) ** ORDER) > 0
            which = np.flatnonzero(there)
            at = (np.cumsum(there) - 1)[number]
        else:
            which, at = np.unique(number, return_inverse=True)
        rows, row = np.unique(row, return_inverse=True)
        counts = np.bincount(at * len(rows) + row, minlength=len(which) * len(rows)) if len(which) * len(rows) <= 1 << 24 else None
        order = None if counts is not None else np.argsort(at, kind="stable")
        total = np.zeros((len(rows), self.dimensions), np.float32)
        for begin in range(0, len(which), SLICE):
            some = which[begin : begin + SLICE]
            if counts is not None:
                n = counts[begin * len(rows) : (begin + len(some)) * len(rows)]
            else:
                a, b = np.searchsorted(at, [begin, begin + len(some)], sorter=order)
                chosen = order[a:b]
                n = np.bincount((at[chosen] - begin) * len(rows) + row[chosen], minlength=len(some) * len(rows))
            grams = np.stack([met[some // len(met) ** (ORDER - 1 - k) % len(met)] for k in range(ORDER)], 1)
            # sums stay below 2 ** 24, where single precision is exact
            total += n.reshape(len(some), len(rows)).T.astype(np.float32) @ self.bound(grams).astype(np.float32)
        out[rows] += total.astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text leaves 2 when divided by 4: such a row is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The languages in code-point order and their prototypes, each of length 1.

    Learned from the text and the non-null lang of all rows of ``docs`` (doc_id, text, lang) outside the held-out part; rows with a null
    doc_id are learned from. Texts without a letter teach nothing, a language that has no others is not learned. Repeated rows count each.
    """
    some = only(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions), {}
        for batch in batches:
            names, row = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            for name, found in zip(names, space.bundles(zip(row.tolist(), map(letters, texts(batch)), strict=True), len(names)), strict=True):
                sums[name] = sums.get(name, 0) + found
        for name, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(found)], ["lang", "d", "v"])

    table = some.mapInArrow(run, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v")).filter("v != 0").toArrow()
    names = sorted(set(table["lang"].to_pylist()), key=lambda x: x.encode())
    sums = np.zeros((len(names), dimensions))
    place = {name: k for k, name in enumerate(names)}
    sums[[place[x] for x in table["lang"].to_pylist()], table["d"].to_numpy()] = table["v"].to_numpy()
    return names, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its cosine (0 where it is negative), ``names``, in place of columns of those names.

    A null text and one without a letter get ``und`` and 0, and so does every text where no language was learned. Ties go to the
    first language in code-point order. All rows and other columns pass unchanged, repeated ones too.
    """
    known, prototypes = model
    shared = docs.sparkSession.sparkContext.broadcast((known, prototypes))
    rest = [c for c in docs.columns if c not in names]
    kept = docs.select(*[docs[c] for c in rest])
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shared.value
        space = Space(matrix.shape[1])
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                codes = list(map(letters, texts(batch)))
                found = space.bundles(enumerate(codes), len(codes)).astype(float)
                said, score = [NONE] * len(codes), np.zeros(len(codes))
                if langs:
                    cosine = found @ matrix.T / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1)
                    best = np.argmax(np.round(cosine, 12), axis=1)
                    for k, c in enumerate(codes):
                        if len(c):
                            said[k], score[k] = langs[best[k]], min(max(cosine[k, best[k]], 0.0), 1.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(score)], [*rest, *names])

    return kept.mapInArrow(run, schema)
