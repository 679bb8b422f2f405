"""Substring deduplication by recompression.

A text is a sequence of symbols, at first the names of its words. A step of recompression names runs of one symbol, then
pairs: each symbol is a left or a right one by a bit of its name, and a left one followed by a right one becomes a pair.
A name is a hash of what it stands for, so it is the same everywhere, and equal substrings get the same interior symbols.
With every symbol goes its context, the words that decided its shape: a symbol whose context lies inside a window is found
in every occurrence of that window.

Each Spark round takes some steps and then looks at the names of all documents together: a name that only one document has
cannot be part of a repeat, so every window around its context is out. What is left of a document are maximal runs of
windows all of whose symbols are shared; the next round makes longer symbols of these alone, up to about half a window.
The windows of the runs that remain (and windows that hold no symbol, as inside a long run of one word) are verified by a
128-bit hash of their words, and the smallest doc_id of each decides. So no repeat is lost, and most windows are never
shuffled. Documents whose whole text a smaller doc_id has take no part: all their windows go.

Shuffles carry names and positions; the tables that decide are written before they are joined, so Spark's adaptive planner
can split the rows of a name or window that very many documents share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import only, texts
from emberline.session import scratch, stored

WINDOW = 50
STEPS = (5, 2)  # of recompression, by Spark round
_FAR, _BEYOND = 1 << 40, 1 << 30
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def recompress(names: np.ndarray, lo: np.ndarray, hi: np.ndarray, steps: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some more steps: names, first word and end of their contexts, and ``of``.

    ``of`` numbers, ascending, the documents that the symbols come from. What lies beyond the ends of a document is not known.
    """
    for _ in range(steps):
        if not len(names):
            break
        # runs: the symbols on both sides tell where a run ends
        start = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (of[1:] != of[:-1])))
        size = np.diff(np.append(start, len(names)))
        next_lo, next_hi, last_lo, last_hi = _sides(lo, hi, of)
        end = start + size - 1
        lo, hi = np.minimum(last_lo[start], np.minimum.reduceat(lo, start)), np.maximum(next_hi[end], np.maximum.reduceat(hi, start))
        names, of = _mix(names[start], size.astype(np.uint64)), of[start]
        # pairs: a left symbol before a right one
        side = (names >> np.uint64(17) & np.uint64(1)).astype(bool)
        joined = np.append(~side[:-1] & side[1:] & (of[1:] == of[:-1]), False)
        first = np.append(True, ~joined[:-1])
        next_lo, next_hi, last_lo, last_hi = _sides(lo, hi, of)
        lo = np.where(side, np.minimum(lo, last_lo), np.minimum(lo, next_lo))
        hi = np.where(side, np.maximum(hi, last_hi), np.maximum(hi, next_hi))
        after = np.where(joined, np.append(names[1:], names[:1]) ^ np.uint64(0x5851F42D4C957F2D), np.uint64(1))
        names, lo, hi, of = _mix(names[first], after[first]), lo[first], hi[first], of[first]
    return names, lo, hi, of


def _sides(lo: np.ndarray, hi: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the symbol after each and of the one before it, in its document."""
    end = np.append(of[1:] != of[:-1], True)
    begin = np.append(True, end[:-1])
    next_lo, next_hi = np.append(lo[1:], _FAR), np.append(hi[1:], _FAR)
    last_lo, last_hi = np.append(-_FAR, lo[:-1]), np.append(-_FAR, hi[:-1])
    next_lo[end] = next_hi[end] = _FAR
    last_lo[begin] = last_hi[begin] = -_FAR
    return next_lo, next_hi, last_lo, last_hi


def alive_runs(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of windows that are alive."""
    edge = np.diff(np.concatenate([[0], alive.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def without(first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of windows without those around the contexts (lo, hi)."""
    fits = hi - lo <= window
    alive = _covered(first, last + 1, n) > 0
    out = _covered(np.clip(hi[fits] - window, 0, n), np.clip(lo[fits] + 1, 0, n), n)
    return alive_runs(alive & (out == 0))


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """By how many of the ranges each of ``n`` positions is covered."""
    return np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n]


def _inside(lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Whether a context lies inside the words of one run of windows, and of one window."""
    at = np.searchsorted(first, lo, side="right") - 1
    held = at >= 0
    at = np.maximum(at, 0)
    return held & (hi <= (last + window)[at]) & (hi - lo <= window) if len(first) else np.zeros(len(lo), bool)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_names(named: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    """Two 64-bit hashes of the windows that start at ``at``, of the hashes of their words."""
    out = []
    for base in _BASES:
        powers = np.append(np.uint64(1), np.cumprod(np.full(window - 1, base, np.uint64)))[::-1]
        value = np.zeros(len(at), np.uint64)
        mixed = _mix(named, np.uint64(base))
        for d in range(window):
            value += mixed[at + d] * powers[d]
        out.append(_mix(value, np.uint64(window)).view(np.int64))
    return out


_STATE = "doc_id long, version long, n int, names array<long>, lo array<int>, hi array<int>, first array<int>, last array<int>, symbols int"
_FIELDS = ["doc_id", "version", "n", "names", "lo", "hi", "first", "last", "symbols"]
GROUP = 1 << 17  # words that are worked on at once: whole documents, laid one after the other, a window's length apart


def _bases(n: np.ndarray, window: int) -> np.ndarray:
    """Where each document of a group begins; ``n`` are their numbers of windows."""
    return np.cumsum(n + window) - (n + window)


def _lists(values: np.ndarray, of: np.ndarray, count: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(count + 1)), pa.int32()), pa.array(values))


def _states(doc: pa.Array, version: pa.Array, n: np.ndarray, names, lo, hi, of, first, last, window: int) -> pa.RecordBatch:
    """The documents of a group that have windows alive.

    Only symbols whose context a window that is alive can hold stay; one without bounds stands for those left out between them.
    """
    base = _bases(n, window)
    held = np.flatnonzero(_inside(lo, hi, first, last, window))
    of = of[held]
    gap = np.flatnonzero((np.diff(held) > 1) & (of[1:] == of[:-1])) + 1
    names, lo, hi = np.insert(names[held], gap, np.uint64(0)), np.insert(lo[held] - base[of], gap, -1), np.insert(hi[held] - base[of], gap, _BEYOND)
    of = np.insert(of, gap, of[gap])
    run = np.searchsorted(base, first, side="right") - 1
    lists = [_lists(x, of, len(n)) for x in (names.view(np.int64), lo.astype(np.int32), hi.astype(np.int32))]
    lists += [_lists((x - base[run]).astype(np.int32), run, len(n)) for x in (first, last)]
    symbols = pa.array(np.bincount(of, minlength=len(n)).astype(np.int32))
    every = pa.RecordBatch.from_arrays([doc, version, pa.array(n.astype(np.int32)), *lists, symbols], _FIELDS)
    return every.filter(pa.array(np.bincount(run, minlength=len(n)) > 0))


def _begin(doc: list[int], version: list[int], named: list[np.ndarray], window: int, steps: int) -> pa.RecordBatch:
    """The states of a group after its first steps, from the names of its words."""
    size = np.fromiter(map(len, named), np.int64, len(named))
    n = size - (window - 1)
    base = _bases(n, window)
    of = np.repeat(np.arange(len(n)), size)
    at = np.arange(len(of)) + (base - np.cumsum(size) + size)[of]
    symbols = recompress(np.concatenate([*named, np.empty(0, np.uint64)]), at, at + 1, steps, of)
    return _states(pa.array(doc, pa.int64()), pa.array(version, pa.int64()), n, *symbols, base, base + n - 1, window)


def _first_round(docs: DataFrame, window: int, steps: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, held = ([], [], []), 0
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch), strict=True):
                words = row[2].split()
                if len(words) >= window:
                    for column, value in zip(group, (*row[:2], _hashes(words)), strict=True):
                        column.append(value)
                    held += len(words)
                if held >= GROUP:
                    yield _begin(*group, window, steps)
                    group, held = ([], [], []), 0
            yield _begin(*group, window, steps)

    return docs.select("doc_id", "version", "text").mapInArrow(run, _STATE)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the row of each; null lists are empty."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(size)), size)


def _go_on(part: pa.RecordBatch, window: int, steps: int) -> pa.RecordBatch:
    """The states of a group after some more steps, without the windows around symbols that are not shared."""
    n = part.column(2).to_numpy().astype(np.int64)
    base = _bases(n, window)
    (names, of), (lo, _), (hi, _), (first, run), (last, _), (shared, owner) = (_flat(part.column(k)) for k in (3, 4, 5, 6, 7, 9))
    lo, hi = lo + base[of], hi + base[of]
    dead = np.ones(len(names), bool)
    dead[shared + np.searchsorted(of, owner)] = False
    first, last = without(first + base[run], last + base[run], lo[dead], hi[dead], int((n + window).sum()), window)
    return _states(part.column(0), part.column(1), n, *recompress(names.view(np.uint64), lo, hi, steps, of), first, last, window)


def _next_round(states: DataFrame, window: int, steps: int) -> DataFrame:
    """(state, shared: numbers of its shared symbols) -> the state after some more steps, without dead windows; none without windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.cumsum(batch.column(2).to_numpy().astype(np.int64)) // GROUP
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield _go_on(batch.slice(a, b - a), window, steps)

    return states.mapInArrow(run, _STATE)


def repeated(docs: DataFrame, window: int = WINDOW, rounds: tuple[int, ...] = STEPS) -> DataFrame:
    """(doc_id, version, whole, gone): for each text that loses words the starts of its repeated windows, or ``whole``.

    ``docs`` (doc_id long, version long, text); version is a hash of the text.
    """
    spark = docs.sparkSession
    with scratch(spark) as own:
        texts_of = docs.select("doc_id", "version", F.xxhash64(F.lit(1), "text").alias("b"))
        texts_of = stored(texts_of.distinct(), "versions")
        least = texts_of.groupBy("version", "b").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "version")
        copies = stored(texts_of.select("doc_id", "version").join(least, ["doc_id", "version"], "left_anti"), "copies")
        key = ["doc_id", "version"]
        taking_part = docs.join(copies, key, "left_anti")

        state = stored(_first_round(taking_part, window, rounds[0]), "symbols")
        for steps in [*rounds[1:], 0]:
            each = state.select(*key, F.posexplode("names").alias("i", "name")).filter("name != 0")
            shared = each.groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a != b").select("name")
            shared = stored(shared, "shared")
            flags = each.join(shared, "name", "left_semi").groupBy(*key).agg(F.collect_list("i").alias("shared"))
            # a text without a shared symbol matters only where it has none at all, or windows that hold none
            state = stored(_next_round(state.join(flags, key, "left"), window, steps), "symbols")

        runs = state.select(*key, "first", "last")

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for doc, version, first, last, text in zip(*[batch.column(k).to_pylist() for k in range(4)], texts(batch), strict=True):
                    named = _hashes(text.split())
                    every = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
                    for k in range(0, len(every), 20000):
                        at = every[k : k + 20000]
                        a, b = window_names(named, at, window)
                        cols = [pa.array(a), pa.array(b), pa.array(np.full(len(at), doc, np.int64)), pa.array(np.full(len(at), version, np.int64)), pa.array(at.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", "doc_id", "version", "at"])

        held = runs.join(docs.dropDuplicates(key), key).select(*key, "first", "last", "text")
        hits = stored(held.mapInArrow(windows, "h1 long, h2 long, doc_id long, version long, at int"), "windows")
        owner = hits.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")).filter("owner != other")
        owner = stored(owner.select("h1", "h2", "owner"), "owners")
        gone = hits.join(owner, ["h1", "h2"]).filter("doc_id > owner").groupBy(*key).agg(F.collect_set("at").alias("gone"))
        whole = copies.select(*key, F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("gone"))
        return own.result(gone.select(*key, F.lit(False).alias("whole"), "gone").unionByName(whole), "repeated")


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: tuple[int, ...] = STEPS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``docs`` (doc_id, text): its text without repeated windows.

    A word goes if a window of ``window`` consecutive words covers it whose words also start in a document with a
    smaller doc_id; windows are judged on the input. Words are runs of anything but ASCII space and U+0009 to
    U+000D, unchanged. Null and empty texts have no words. Rows that share a doc_id are one document and do not
    remove each other. A row without a doc_id neither removes nor loses words; a doc_id that is no number raises.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError("doc_id must be a whole number")
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    found = repeated(rows.filter("doc_id IS NOT NULL AND text IS NOT NULL"), window, rounds)
    found = found.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "whole", "gone")
    final = rows.join(found, (rows["doc_id"] == found["_doc"]) & (rows["version"] == found["_version"]), "left").select("doc_id", "text", "whole", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, whole, gone in zip(texts(batch), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = text.split()
                kept = [] if whole and len(words) >= window else words
                if gone.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = gone.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    kept = [w for w, n in zip(words, np.cumsum(edge).tolist(), strict=False) if n == 0]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8")))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return final.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
