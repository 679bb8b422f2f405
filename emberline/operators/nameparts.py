"""Parts of names alike, without comparing all pairs and without losing one.

The ratio of two strings is 2c / (m + n) with c the length of their longest common subsequence, so a pair of lengths m and n
reaches ``least`` exactly if some c' = ceil(least * (m + n) / 2) letters are left in both when others are deleted. For short
parts all such remainders are keys, with both lengths, and a common key is the answer. Where one part is longer than
``SHORT`` letters remainders are too many: a common subsequence of c letters keeps 3c - (m + n) + 1 pairs of
neighbours (or, where that bounds nothing, c letters), so the rarest of them meet by prefixes and the ratio decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.names import ratio
from emberline.session import scratch, stored

SHORT = 10
EPS = 1e-9


def _needed(least: float, m: int, n: int) -> int:
    """Letters that parts of m and n letters must share in order."""
    return ceil(least * (m + n) / 2 - EPS)


def remainders(part: str, least: float, short: int = SHORT) -> list[tuple[int, str]]:
    """(n, rest): for each length n that the other part may have, what may be left of a part of at most ``short`` letters."""
    m, out = len(part), []
    for n in range(1, short + 1):
        c = _needed(least, m, n)
        if c <= min(m, n):
            out += [(n, rest) for rest in sorted({"".join(kept) for kept in combinations(part, c)})]
    return out


def _short_pairs(parts: DataFrame, least: float) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b["part"].to_pylist():
                found = remainders(part, least)
                columns = [part] * len(found), [len(part)] * len(found), [n for n, _ in found], [rest for _, rest in found]
                yield pa.RecordBatch.from_pydict(dict(zip(("part", "m", "n", "rest"), columns, strict=True)), schema=schema)

    schema = pa.schema([("part", pa.string()), ("m", pa.int32()), ("n", pa.int32()), ("rest", pa.string())])
    keyed = stored(parts.filter(F.length("part") <= SHORT).mapInArrow(keys, "part string, m int, n int, rest string"), "remainders")
    # each has the length that the other one's key is meant for
    return keyed.toDF("x", "m", "n", "rest").join(keyed.toDF("y", "n", "m", "rest"), ["m", "n", "rest"]).filter("x < y").select("x", "y").distinct()


def _grams(part: Column, q: int) -> Column:
    """Pairs of neighbours with the ends marked, or letters; repeats are numbered."""
    text = F.concat(F.lit("\u0001"), part, F.lit("\u0002")) if q == 2 else part
    each = F.transform(F.sequence(F.lit(1), F.length(text) - (q - 1)), lambda i: F.substring(text, i, F.lit(q)))
    return F.transform(each, lambda g, i: F.concat(g, F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda h: h == g)).cast("string")))


def _long_pairs(parts: DataFrame, least: float) -> DataFrame:
    # pairs of neighbours bound something from a ratio of two thirds on
    q = 2 if least > 2 / 3 else 1
    shared = (1.5 * least - 1) * F.lit(2.0) / (2 - least) * F.col("m") + 1 if q == 2 else F.col("m") * (least / (2 - least))
    reach = least / (2 - least)  # the other length is at least this share of one's own
    sized = stored(parts.select("part", F.length("part").alias("m")).filter(F.col("m") >= (SHORT + 1) * reach - EPS), "sized")
    each = stored(sized.select("part", "m", F.explode(_grams(F.col("part"), q)).alias("g")), "grams")
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("part").orderBy("df", "g")
    first = each.join(often, "g").withColumn("at", F.row_number().over(rare))
    kept = F.col("m") + (q - 1) - F.greatest(F.ceil(shared - EPS), F.lit(1)) + 1
    first = stored(first.filter(F.col("at") <= kept).select("part", "m", "g"), "prefixes")
    fits = f"x < y AND greatest(m, n) > {SHORT} AND least(m, n) >= greatest(m, n) * {reach} - {EPS}"
    met = first.toDF("x", "m", "g").join(first.toDF("y", "n", "g"), "g").filter(fits).select("x", "y").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = [ratio(x, y) >= least - EPS for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True)]
            yield b.filter(pa.array(alike, pa.bool_()))

    return met.mapInArrow(compare, "x string, y string")


def similar_parts(parts: DataFrame, least: float) -> DataFrame:
    """(x, y), x < y: the different values of ``part`` whose ratio is ``least`` (0.5 to 1) or more; null and empty parts are like none."""
    if not 0.5 <= least <= 1:
        raise ValueError("least must be between 0.5 and 1")
    with scratch(parts.sparkSession) as own:
        rows = stored(parts.select("part").filter("part != ''").distinct(), "parts")
        return own.result(_short_pairs(rows, least).unionByName(_long_pairs(rows, least)), "similar-parts")


def begun(parts: DataFrame) -> DataFrame:
    """(x, y): each part x and each other part y that begins with it."""
    rows = parts.select("part").filter("part != ''").distinct()
    heads = rows.select(F.col("part").alias("y"), F.explode(F.sequence(F.lit(1), F.length("part"))).alias("i"))
    heads = heads.filter(F.col("i") < F.length("y")).select("y", F.substring(F.col("y"), F.lit(1), F.col("i")).alias("x"))
    return heads.join(rows.withColumnRenamed("part", "x"), "x").select("x", "y")
