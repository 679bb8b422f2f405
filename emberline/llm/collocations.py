"""Phrase collocation mining with vertical positional inverted lists.

Words of each language stand at numbered positions; pieces (between punctuation) are one position apart, so no phrase
crosses their border. A shard, some million words of one partition and language, is one row: the positions of every word, and for
each level k the positions of every frequent phrase of k words. A phrase is extended inside its shards, by merging its
positions with the postings of the words that stand next to them; the length of a list is the phrase's frequency there, and
the sum over shards is exact. Only frequent phrases, whose ends are frequent too, are extended, and no shard is ever shuffled:
what is shuffled is counts, summed within a task and sent in blocks.

Which phrases are frequent reaches the shards as a bitmap of fixed size. It lets some infrequent ones pass as well, so
it only saves work: frequencies are those summed by the phrases' own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import only, texts
from emberline.session import LARGE_ROWS, forget, scratch, small_batches, stored

LEAST, MOST_WORDS, FIRST, SHARE = 100, 5, 2000, 100
SHARD = 1 << 20  # words
BITS = 25  # of the bitmap's size
HELD = 8  # rows of an Arrow batch where a row is a shard
NONE = "und"
#: A-Z in lower case, tabs as blanks, the ends of pieces as line feeds.
_FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c | 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit key of two keys, in their order."""
    with np.errstate(over="ignore"):
        x = first.view(np.uint64) * _A + last.view(np.uint64)
        x = (x ^ x >> np.uint64(30)) * _B
        x = (x ^ x >> np.uint64(27)) * _C
    return (x ^ x >> np.uint64(31)).view(np.int64)


def _lists(keys: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys, the lengths of their lists, the lists one behind the other, and the first of ``more`` for each key.

    ``more[0]`` are positions in ascending order; they stay so within a list.
    """
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(found)))
    return found[starts], sizes, more[0][order], *(m[order][starts] for m in more[1:])


def _by_position(keys: np.ndarray, sizes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of lists, merged into one ascending list."""
    order = np.argsort(positions, kind="stable")
    return positions[order], np.repeat(keys, sizes)[order]


class Passed:
    """A bitmap of keys."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(keys: DataFrame, bits: int = BITS) -> Passed:
    """The bitmap of the column ``key``, joined on Spark into 2 ** (bits - 6) numbers at most, whatever the number of keys."""
    slot = F.shiftrightunsigned(F.col("key"), 64 - bits)
    found = keys.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63L as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Passed(words, bits)


def _blob(a: np.ndarray) -> pa.Array:
    """One array as compressed differences, which are small where it ascends; they wrap, so any array comes back."""
    with np.errstate(over="ignore"):
        steps = np.diff(a, prepend=a.dtype.type(0))
    return pa.array([zstandard.compress(steps.tobytes(), 1)], pa.binary())


def _read(value: pa.Scalar, kind) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(value.as_buffer()), kind), dtype=kind)


def postings(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(lang, n, words, keys, sizes, positions): one row a shard; the lists of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (words, ends) in held.items():
                if not words:
                    continue
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
                keys = mixed(np.full(1, xxhash.xxh64_intdigest(lang, 13), np.uint64), hashes)
                place = np.arange(len(words), dtype=np.int32)
                gaps = np.zeros(len(words) + 1, np.int32)
                np.add.at(gaps, np.array(ends, np.int64), 1)
                found, sizes, positions, which = _lists(keys, place + np.cumsum(gaps[:-1], dtype=np.int32), place)
                named = pa.array([[words[i].decode("utf-8", "replace") for i in which]], pa.list_(pa.string()))
                out = [pa.array([lang]), pa.array([len(words)]), named, pa.array([found], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), _blob(positions)]
                yield pa.RecordBatch.from_arrays(out, ["lang", "n", "words", "keys", "sizes", "positions"])
            held.clear()

        for batch in batches:
            for text, lang in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                words, ends = held.setdefault(NONE if lang is None else lang, ([], []))
                for piece in text.translate(_FOLD).split(b"\n"):
                    # only blanks part words; \x1c and the like are none of what bytes.split() cuts at
                    if found := piece.split():
                        words += found
                        ends.append(len(words))
                        size += len(found)
                        if size >= shard:
                            yield from rows()
                            size = 0
                            words, ends = held.setdefault(NONE if lang is None else lang, ([], []))
        yield from rows()

    return only(docs, "text", "lang").mapInArrow(run, "lang string, n long, words array<string>, keys array<long>, sizes array<long>, positions binary")


def _pairs(row: dict, words_pass: Passed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of pairs of words that pass, and the keys of both."""
    keys, sizes, positions = row
    kept = words_pass(keys)
    positions = positions[np.repeat(kept, sizes)]
    at, word = _by_position(keys[kept], sizes[kept], positions)
    near = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[near], word[near], word[near + 1]


def _merged(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows with equal identities (all columns but the last) become one, the last columns added up; in order of the first column."""
    *identity, n = columns
    order = np.lexsort(identity[::-1])
    identity = [c[order] for c in identity]
    if not len(order):
        return (*identity, n)
    starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in identity], axis=0)]))
    return (*(c[starts] for c in identity), np.add.reduceat(n[order], starts))


def _counted(rows: DataFrame, found, fields: str, least: int, words: int, held: int = 1 << 21) -> DataFrame:
    """(``fields``, n) of what ``found`` gives for each row of a batch, summed over all rows, where n is ``least`` or more.

    ``found(batch, i)`` gives equally long arrays: an unsigned key, whose high bits are spread evenly, further parts of the identity, and
    counts. A task adds up what it holds and sends it in blocks, one a range of keys; ranges are as many as there are million
    words, so a range is bounded, and no key is hot in it, as it comes once a task and block.
    """
    names = [*fields.split(), "n"]
    bits = max(6, (words >> 20).bit_length())
    kinds = [np.uint64] * (len(names) - 1) + [np.int64]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            columns = _merged(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            parts.clear()
            ends = np.searchsorted(columns[0] >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64), side="right")
            starts = np.append(0, ends[:-1])
            for part in np.flatnonzero(ends > starts).tolist():
                data = [_blob(c[starts[part] : ends[part]]) for c in columns[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *data, _blob(columns[-1][starts[part] : ends[part]].astype(np.int32))], ["part", *names])

        for batch in batches:
            for i in range(batch.num_rows):
                parts.append(tuple(c.astype(k, copy=False) for c, k in zip(found(batch, i), kinds, strict=True)))
                size += len(parts[-1][0])
                if size >= held:
                    yield from blocks()
                    size = 0
        if parts:
            yield from blocks()

    def add(table: pa.Table) -> pa.Table:
        columns = [np.concatenate([_read(x, np.int32 if c == "n" else np.uint64) for x in table[c]]) for c in names]
        *identity, n = _merged(*columns[:-1], columns[-1].astype(np.int64))
        kept = n >= least
        return pa.Table.from_arrays([*(pa.array(c[kept].view(np.int64)) for c in identity), pa.array(n[kept])], names)

    shape = "part int, " + ", ".join(f"{c} binary" for c in names)
    return rows.mapInArrow(run, shape).groupBy("part").applyInArrow(add, ", ".join(f"{c} long" for c in names))


def _pair_counts(shards: DataFrame, words_pass, least: int, words: int) -> DataFrame:
    """(key, n) of the frequent pairs of frequent words."""

    def found(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
        _, first, last = _pairs(_words(batch, i), words_pass.value)
        key, n = np.unique(mixed(first, last).view(np.uint64), return_counts=True)
        return key, n

    return _counted(shards.select("keys", "sizes", "positions"), found, "key", least, words)


def _words(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column(0)[i].values.to_numpy(), batch.column(1)[i].values.to_numpy(), _read(batch.column(2)[i], np.int32)


#: One row a shard: the postings of words that may extend a phrase, and the lists of the phrases of a level.
_LEVEL = "lang string, word_keys binary, word_sizes binary, word_positions binary, keys array<long>, heads array<long>, tails array<long>, sizes array<long>, positions binary"


def _level_row(lang: pa.Array, at: np.ndarray, key: np.ndarray, head: np.ndarray, tail: np.ndarray, words: tuple) -> pa.RecordBatch:
    """``at`` are the places of phrases, ``head`` and ``tail`` the keys of their beginnings and last words."""
    found, sizes, positions, heads, tails = _lists(key, at, head, tail)
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (found, heads, tails, sizes)]
    out = [lang, _blob(words[0]), _blob(words[1]), _blob(words[2]), *lists, _blob(positions)]
    return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in _LEVEL.split(", ")])


def _second(shards: DataFrame, words_pass, pairs_pass) -> DataFrame:
    """The level of pairs: lists of those that pass, and the postings of their last words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, first, last = _pairs(_words(batch, i), words_pass.value)
                key = mixed(first, last)
                kept = pairs_pass.value(key)
                at, first, last, key = at[kept], first[kept], last[kept], key[kept]
                if len(at):
                    yield _level_row(batch.column(3).slice(i, 1), at, key, first, last, _lists(last, at + np.int32(1)))

    return shards.select("keys", "sizes", "positions", "lang").mapInArrow(run, _LEVEL)


def _next(level: DataFrame, length: int, passed) -> DataFrame:
    """From the lists of phrases of ``length`` words those of one word more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = _read(batch.column(1)[i], np.int64), _read(batch.column(2)[i], np.int64), _read(batch.column(3)[i], np.int32)
                key, sizes, positions = batch.column(4)[i].values.to_numpy(), batch.column(7)[i].values.to_numpy(), _read(batch.column(8)[i], np.int32)
                kept = passed.value(key)
                positions = positions[np.repeat(kept, sizes)]
                at, phrase = _by_position(key[kept], sizes[kept], positions)
                # the phrase without its first word must be frequent too: it starts one position on
                both = np.flatnonzero(at[1:] == at[:-1] + 1)
                at, phrase = at[both], phrase[both]
                place, word = _by_position(*words)
                met = np.searchsorted(place, at + np.int32(length))
                met = np.minimum(met, len(place) - 1)
                there = place[met] == at + np.int32(length)
                at, phrase, word = at[there], phrase[there], word[met[there]]
                if len(at):
                    yield _level_row(batch.column(0).slice(i, 1), at, mixed(phrase, word), phrase, word, _lists(word, at + np.int32(length)))

    return level.mapInArrow(run, _LEVEL)


def _frequent(level: DataFrame, least: int, words: int) -> DataFrame:
    """(key, head, tail, n) of the frequent phrases of a level: lengths of their lists, summed over the shards."""

    def found(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
        key, head, tail, sizes = (batch.column(c)[i].values.to_numpy() for c in range(4))
        return key.view(np.uint64), head.view(np.uint64), tail.view(np.uint64), sizes

    return _counted(level.select("keys", "heads", "tails", "sizes"), found, "key head tail", least, words)


def mine(docs: DataFrame, least: int = LEAST, first: int = FIRST, most_words: int = MOST_WORDS, share: int = SHARE, shard: int = SHARD, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``first`` phrases, from ``docs`` (doc_id, text, lang).

    Words are runs of anything but blanks and tabs inside pieces, A-Z in lower case. Phrases have 2 to ``most_words`` words and occur
    ``least`` times or more; the score is that of the lowest-scoring cut, floor(1000 a n / (l r)), ties to the
    shortest first part. A phrase inside a longer one that is at least ``share`` percent as frequent is dropped. Ties of score go
    to the more frequent, then to the smaller by UTF-8 bytes. A null text is empty, a null lang ``und``, like that of the name; repeated
    rows count each; an empty table, or one without frequent phrases, gives no rows. A piece is never cut, so one of
    very many words makes a shard of its size.
    """
    spark = docs.sparkSession
    share_out = spark.sparkContext.broadcast
    with scratch(spark) as own, small_batches(spark):
        shards = stored(postings(docs, shard), "postings", LARGE_ROWS)
        where = spark._emberline_made[-1]
        n = stored(shards.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
        size = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        each = shards.select("lang", F.explode(F.arrays_zip("words", "keys", "sizes")).alias("x"))
        each = each.select("lang", F.col("x.words").alias("phrase"), F.col("x.keys").alias("key"), F.col("x.sizes").alias("a"))
        words = stored(each.groupBy("lang", "phrase", "key").agg(F.sum("a").alias("a")).filter(F.col("a") >= least), "words")
        if not words.groupBy("key").count().filter("count > 1").isEmpty():
            raise RuntimeError("two frequent words have the same 64-bit key")
        words_pass = share_out(bitmap(words, bits))
        with small_batches(spark, HELD):
            pairs = stored(_pair_counts(shards, words_pass, least, size), "pairs")
            pairs_pass = share_out(bitmap(pairs, bits))
            level = stored(_second(shards, words_pass, pairs_pass), "level", LARGE_ROWS)
        forget(spark, where)
        named, phrases = words.select("lang", F.col("key").alias("head"), "phrase"), []
        last = words.select(F.col("key").alias("tail"), F.col("phrase").alias("_word"))
        for length in range(2, most_words + 1):
            found = _frequent(level, least, size).join(named, "head").join(last, "tail")
            with small_batches(spark, HELD):
                found = stored(found.select("lang", F.concat_ws(" ", "phrase", "_word").alias("phrase"), F.lit(length).alias("size"), F.col("n").alias("a"), "key"), "phrases")
            if found.isEmpty():
                break
            phrases.append(found)
            if length < most_words:
                named = found.select("lang", F.col("key").alias("head"), "phrase")
                passed = share_out(bitmap(found, bits))
                with small_batches(spark, HELD):
                    level = stored(_next(level, length, passed), "level", LARGE_ROWS)
        if not phrases:
            return own.result(spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long"), "collocations")
        candidates = phrases[0]
        for more in phrases[1:]:
            candidates = candidates.unionByName(more)
        counts = words.select("lang", "phrase", "a").unionByName(candidates.select("lang", "phrase", "a"))
        kept = _not_inside(candidates.select("lang", "phrase", "size", "a"), share)
        return own.result(_ranked(kept, counts, n, first), "collocations")


def _not_inside(candidates: DataFrame, share: int) -> DataFrame:
    """Candidates that no longer one of about the same frequency holds."""
    parts = F.split("phrase", " ")
    starts = lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(parts, i, k), " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), starts))
    inside = candidates.filter("size > 2").select(F.col("lang").alias("_lang"), F.col("a").alias("_a"), F.explode(inner).alias("_phrase"))
    inside = inside.groupBy("_lang", "_phrase").agg(F.max("_a").alias("_a"))
    held = (candidates["lang"] == inside["_lang"]) & (candidates["phrase"] == inside["_phrase"]) & (F.col("_a") * 100 >= F.lit(share) * F.col("a"))
    return candidates.join(inside, held, "left_anti")


def _ranked(candidates: DataFrame, counts: DataFrame, n: DataFrame, first: int) -> DataFrame:
    parts = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " "))
    of = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(value))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(n, "lang")
    # products of 18 digits each have 36; with the thousand they stay below 38 for texts of up to 10 ** 17 words
    score = F.expr("(cast(1000 * cast(a as decimal(18,0)) as decimal(21,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    best = best.select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r")
    by_lang = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(by_lang)).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
