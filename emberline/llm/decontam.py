"""Benchmark decontamination by SimHash of item-sized windows, natively.

A window that is similar to an item shares a shingle with it, so windows are laid only where a shared shingle aligns
a document with an item (every occurrence on both sides proposes its alignment, so nothing is lost). Each window, as
long as the item, gets a 64-bit SimHash of its shingles, as every item does. The multi-index then finds, for each
different window and the items that it was laid for, those whose fingerprint is within the radius: fingerprints are cut into
radius + 1 blocks, and two within the radius agree in one block at least. Windows never meet items that share no shingle at
their place. What is found is verified by the exact
weighted similarity of the two shingle multisets: sum of the smaller counts over the sum of the larger ones.

The result is the pairs of ``similarity`` or more whose fingerprints are within ``radius``. At a similarity of 0.8 two
fingerprints differ by 9.7 of 64 bits in the mean, with a standard deviation of 2.9, so a radius of 26 passes over
one such pair in some ten million.

A shingle is five words; an item of fewer words is one shingle, of all its words. Texts are read twice: once to find
the documents that share a shingle, once to hash these. Only their shingles are stored. Equal windows of any number
of documents are compared once. Sides are broadcast only where Spark finds them small by the size of their files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import only
from emberline.session import scratch, stored

WORDS, SIMILARITY, RADIUS = 5, 0.8, 26
_SKIP = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SKIP), lambda w: w != F.lit(""))


def _shingles(w: str, k: int) -> Column:
    """The hash of every shingle of ``k`` words of the array column ``w``; of fewer words: none."""
    at = lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)])
    none = F.array().cast("array<bigint>")
    return F.when(F.size(w) < k, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w), F.lit(k)) - k), at))


def _simhash(hashes: Column) -> Column:
    """Bit b is 1 if it is set in over half of the hashes."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    count = lambda b: F.size(F.filter(hashes, lambda x: F.getbit(x, b) == 1))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: 2 * count(b) > F.size(hashes))
    return F.aggregate(bits, none, lambda s, b: s.bitwiseOR(F.call_function("shiftleft", one, b)))


def _blocks(fp: str, radius: int) -> Column:
    """The blocks of a fingerprint, the number of the block in front of its bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.struct(F.lit(i).alias("block"), p.alias("value")) for i, p in enumerate(parts)])


def _numbered(hashes: Column) -> Column:
    """A multiset, as a sorted array, as a set: each hash with the number of its occurrence."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, (i - F.array_position(hashes, x)).cast("long")))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity): the best window of each leaked pair.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text). A window begins where a shared shingle aligns the document
    with the item, and is as many words as the item, or the rest of the document where that is shorter. Ties take the first window. Null and empty texts hold and leak nothing; a
    document leaks a short item where it has just its words. Repeated rows of one doc_id or item_id give one row a
    pair of ids. Rows without a doc_id or item_id take no part.
    """
    with scratch(docs.sparkSession) as own:
        items = only(benchmark, "item_id", "text").filter("item_id IS NOT NULL").select("item_id", _words(F.col("text")).alias("w"))
        items = stored(items.select("item_id", "w", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(WORDS)).alias("k")), "items").filter("k > 0")
        # the kinds of shingles: five words, and as many as a shorter item has
        kinds = sorted(r["k"] for r in items.select("k").distinct().collect())
        if not kinds:
            return own.result(docs.sparkSession.createDataFrame([], _result_schema(docs, benchmark)))
        hashes = lambda: F.coalesce(*[F.when(F.col("k") == k, _shingles("w", k)) for k in kinds])
        hashed_items = stored(items.select("item_id", "n_words", "k", hashes().alias("h")), "item-shingles")
        prints = hashed_items.select("item_id", "n_words", "k", F.sort_array("h").alias("sorted"), _simhash(F.col("h")).alias("item_fp"))
        prints = stored(prints.dropDuplicates(["item_id", "n_words", "sorted"]), "item-prints")
        anchors = hashed_items.select("item_id", "k", "n_words", F.posexplode("h").alias("at", "s")).distinct()
        anchors = stored(anchors, "anchors")

        named = only(docs, "doc_id", "text").filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), _words(F.col("text")).alias("w"))
        known = anchors.select("s").distinct()
        every = named.select("doc_id", "version", F.explode(F.concat(*[_shingles("w", k) for k in kinds])).alias("s"))
        hit = stored(every.join(known, "s", "left_semi").select("doc_id", "version").distinct(), "hit")
        each = F.array(*[F.struct(F.lit(k).alias("k"), _shingles("w", k).alias("h")) for k in kinds])
        held = named.join(hit, ["doc_id", "version"], "left_semi").select("doc_id", "version", F.explode(each).alias("x"))
        held = stored(held.select("doc_id", "version", "x.k", "x.h").dropDuplicates(["doc_id", "version", "k"]), "shingles")

        met = held.select("doc_id", "version", "k", F.posexplode("h").alias("pos", "s")).join(anchors, ["s", "k"])
        starts = met.select("doc_id", "version", "k", "n_words", "item_id", F.greatest(F.col("pos") - F.col("at"), F.lit(0)).alias("start")).distinct()
        # a window is laid once for all items that propose it
        starts = starts.groupBy("doc_id", "version", "k", "n_words", "start").agg(F.collect_set("item_id").alias("for"))
        laid = held.join(starts, ["doc_id", "version", "k"])
        part = F.sort_array(F.slice("h", F.col("start") + 1, F.col("n_words") - F.col("k") + 1))
        laid = laid.select("doc_id", "start", "n_words", "k", "for", part.alias("window"))
        name = [F.xxhash64("n_words", "k", "window").alias("name_a"), F.hash("k", "window").alias("name_b")]
        laid = stored(laid.select("*", *name), "windows")
        different = laid.groupBy("name_a", "name_b").agg(F.first("n_words").alias("n_words"), F.first("k").alias("k"), F.first("window").alias("window"))
        different = stored(different, "different")
        different = stored(different.withColumn("fp", _simhash(F.col("window"))), "window-prints")

        # the multi-index: the items that a window was laid for, met in any block of their fingerprints
        proposed = laid.select("name_a", "name_b", F.explode("for").alias("item_id")).distinct()
        left = different.select("name_a", "name_b", "n_words", "k", "fp").join(proposed, ["name_a", "name_b"])
        left = left.select("name_a", "name_b", "item_id", "n_words", "k", "fp", F.explode(_blocks("fp", radius)).alias("b"))
        right = prints.select("item_id", "n_words", "k", "item_fp", F.explode(_blocks("item_fp", radius)).alias("b"))
        distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
        near = left.join(right, ["item_id", "n_words", "k", "b"]).filter(distance <= radius)
        near = near.select("name_a", "name_b", "item_id", "n_words", "item_fp", distance.alias("distance")).distinct()
        found = near.join(different.select("name_a", "name_b", "window"), ["name_a", "name_b"]).join(prints.select("item_id", "n_words", "item_fp", "sorted"), ["item_id", "n_words", "item_fp"])
        found = found.withColumn("a", _numbered(F.col("window"))).withColumn("b", _numbered(F.col("sorted")))
        found = found.withColumn("similarity", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).filter(F.col("similarity") >= similarity)
        found = stored(found.select("name_a", "name_b", "item_id", "distance", "similarity"), "similar")

        pairs = laid.select("doc_id", "start", "n_words", "name_a", "name_b", F.explode("for").alias("item_id")).join(found, ["name_a", "name_b", "item_id"])
        best = F.max_by(F.struct("start", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("start")))
        pairs = pairs.groupBy("doc_id", "item_id").agg(best.alias("x"))
        return own.result(pairs.select("doc_id", "item_id", F.col("x.start").alias("start_word"), F.col("x.n_words").alias("n_words"), F.col("x.distance").alias("distance"), F.col("x.similarity").alias("similarity")))


def _result_schema(docs: DataFrame, benchmark: DataFrame) -> str:
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    return f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word int, n_words int, distance int, similarity double"


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no leak; rows without a doc_id stay."""
    bad = leaks(docs, benchmark, **how).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
