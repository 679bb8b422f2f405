"""One-permutation MinHash with optimal densification and packed low-order bits, natively.

Every five-word shingle is hashed once. The top bits of the hash name one of ``BINS`` bins and each bin keeps
its smallest hash: sorting the hashes puts each bin's minimum first in its stretch. An empty bin j takes the
value of the first filled bin along j's own pseudo-random order of all bins (optimal densification: the orders
are independent of each other and of the document). A fingerprint packs the low ``BITS`` bits of every bin; two
fingerprints agree in a bin with probability J + (1 - J) / 2**BITS, from which the likeness J is corrected.

All of this happens inside the row: no shuffle, and no row larger than the document's own hashes.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import only, words_of

BINS, BITS, WORDS, PROBES = 128, 8, 5, 8
_TOP = 63 - BINS.bit_length() + 1  # hashes are made 63-bit; what is above this names the bin


def _mix(x: int) -> int:
    """The finaliser of SplitMix64."""
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def orders() -> list[list[int]]:
    """For each bin all bins in a pseudo-random order of its own."""
    return [sorted(range(BINS), key=lambda i: _mix(j * BINS + i)) for j in range(BINS)]


def _orders() -> Column:
    """``orders()`` as a constant that Catalyst folds."""
    return F.from_json(F.lit(json.dumps(orders())), "array<array<int>>")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the array<long> column ``out``: the packed fingerprint of column ``text``.

    A null text counts as empty. A text of fewer than five words is one shingle, its whole word sequence
    (of no words: the empty one), so equal texts have equal fingerprints whatever their length.
    """
    keep = [F.col(c) for c in df.columns]
    w, h, m, p = (f"_{out}_{x}" for x in "whmp")
    step = df.select(*keep, words_of(F.col(text)).alias(w))
    at = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WORDS)]), 1)
    whole = F.array(F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", F.col(w))), 1))
    hashes = F.when(F.size(w) < WORDS, whole).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w), F.lit(WORDS)) - WORDS), at))
    step = step.select(*keep, F.sort_array(hashes).alias(h))
    first = lambda x, i: (i == 0) | (F.shiftright(x, _TOP) != F.shiftright(F.get(F.col(h), i - 1), _TOP))
    step = step.select(*keep, F.filter(F.col(h), first).alias(m))
    bins = F.transform(F.col(m), lambda x: F.shiftright(x, _TOP).cast("int"))
    step = step.select(*keep, m, bins.alias(h))
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    step = step.select(*keep, m, F.when(F.size(m) < BINS, F.transform(every, lambda j: F.array_position(F.col(h), j).cast("int"))).otherwise(F.sequence(F.lit(1), F.lit(BINS))).alias(p))

    def filled(j: Column) -> Column:
        order = F.get(_orders(), j)
        found = lambda some: F.get(F.filter(some, lambda b: F.get(F.col(p), b) > 0), F.lit(0))
        take = F.coalesce(found(F.slice(order, 1, PROBES)), found(order))
        return F.get(F.col(m), F.when(F.get(F.col(p), j) > 0, F.get(F.col(p), j)).otherwise(F.get(F.col(p), take)) - 1)

    step = step.select(*keep, F.when(F.size(m) < BINS, F.transform(every, filled)).otherwise(F.col(m)).alias(h))
    each = 64 // BITS
    low = lambda i: F.get(F.col(h), i).bitwiseAND(F.lit((1 << BITS) - 1))

    def packed(g: Column) -> Column:
        word = F.shiftleft(low(g * each), 64 - BITS)
        for k in range(1, each):
            word = word.bitwiseOR(F.shiftleft(low(g * each + k), 64 - BITS * (k + 1)))
        return word

    return step.select(*keep, F.transform(F.sequence(F.lit(0), F.lit(BINS // each - 1)), packed).alias(out))


def as_text(packed: Column) -> Column:
    """A packed fingerprint as lowercase hex."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two packed fingerprints, 0 to 1."""
    ones = F.lit(int("01" * (64 // BITS), 16))

    def unlike(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for s in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, s))
        return F.bit_count(z.bitwiseAND(ones))

    off = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), ((1 - off / F.lit(float(BINS))) - chance) / (1 - chance))


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> tuple[DataFrame, Window]:
    """Rows in ranges of doc_id, each range with a copy (``_ghost``) of the row that follows it, and the window of a range.

    ``lead`` over the window then sees the next row by ascending doc_id for every row that is no ghost; the first
    row follows the last. Nulls come first; rows that share a doc_id follow each other by text. Only the bounds of
    the ranges, as many as ``buckets``, pass through the driver.
    """
    cuts = [(i + 1) / buckets for i in range(buckets - 1)] or [0.5]
    row = docs.agg(F.percentile_approx("doc_id", cuts, 100 * buckets).alias("cuts"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted(set(row["cuts"] or []))
    last = len(bounds)
    if bounds:
        own = F.coalesce(F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("doc_id"))), F.lit(0))
    else:
        own = F.lit(0)
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(own)
    head = F.col("doc_id").isNull() if row["nulls"] else F.col("doc_id") == F.lit(row["least"])
    places = [F.struct(own.alias("bucket"), F.lit(False).alias("ghost"))]
    if bounds:
        places.append(F.when(F.col("doc_id").isin(bounds), F.struct((own - 1).alias("bucket"), F.lit(True).alias("ghost"))))
    places.append(F.when(head, F.struct(F.lit(last).alias("bucket"), F.lit(True).alias("ghost"))))
    dealt = docs.select(*columns, F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())).alias("_at"))
    dealt = dealt.select(*columns, F.col("_at.bucket").alias("_bucket"), F.col("_at.ghost").alias("_ghost"))
    # the last range ends with the table's first row, every other with the first row of the next range
    dealt = dealt.repartitionByRange(last + 1, "_bucket")
    return dealt, Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "text")


def edited_pairs(docs: DataFrame, buckets: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): fingerprints of its text and of its edited text, and their likenesses.

    The edited text replaces the last floor(n / 2) code points by as many (or all) of the next document's.
    Columns: doc_id, n_chars, edited_sha256, packed, edited_packed, near_edited, near_next.
    """
    docs = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows, window = with_next(docs, ["doc_id", "text"], buckets)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.lead("text").over(window), F.lit(1), half))
    # a ghost has nothing after it and is dropped; its fingerprint is what its range's last row is compared to
    rows = rows.withColumn("edited", F.coalesce(edited, F.lit("")))
    rows = with_fingerprint(rows, "text", "packed")
    rows = rows.withColumn("next_packed", F.lead("packed").over(window)).filter(~F.col("_ghost"))
    rows = with_fingerprint(rows, "edited", "edited_packed")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "packed",
        "edited_packed",
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
