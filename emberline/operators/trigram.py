"""Names alike by trigrams, above a threshold, without comparing all pairs.

Two sets whose Jaccard similarity is above t share more than t times the larger set's members. So with all trigrams in one
order, the rarest first, a pair meets among the first n - floor(t * n) of each set, and sets of too different size never do.
At each meeting the places left in both sets bound what they can still share. Equal names are one node. Up to ``FEW`` different names that are
asked for are compared with every known name of fitting size instead, which takes one pass; the pairs are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.names import jaccard, trigrams
from emberline.session import scratch, stored


#: So many names at most are compared with every known one.
FEW = 64


def _prefixes(sets: DataFrame, often: DataFrame, threshold: float) -> DataFrame:
    """(name, n, t, at): the first trigrams of each set, the rarest first, with their places."""
    each = sets.select("name", F.size("g").alias("n"), F.explode("g").alias("t")).join(often, "t", "left")
    rare = Window.partitionBy("name").orderBy(F.coalesce("df", F.lit(0)), "t")
    return each.withColumn("at", F.row_number().over(rare)).filter(F.col("at") <= F.col("n") - F.floor(F.col("n") * threshold + 1e-9)).select("name", "n", "t", "at")


def candidates(asked: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(q, name): pairs of (name, g) of both sides that may be above the threshold."""
    often = known.select(F.explode("g").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    a = _prefixes(asked, often, threshold).toDF("q", "na", "t", "qa")
    b = _prefixes(known, often, threshold).toDF("name", "nb", "t", "at")
    fits = (F.col("na") > F.col("nb") * threshold - 1e-9) & (F.col("nb") > F.col("na") * threshold - 1e-9)
    met = a.join(b, "t").filter(fits).groupBy("q", "name", "na", "nb")
    met = met.agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("qa", "at")).alias("last"))
    # behind the last common place of the prefixes no more than the rest of either set can be shared
    most = F.col("k") + F.least(F.col("na") - F.col("last.qa"), F.col("nb") - F.col("last.at"))
    return met.filter(most > threshold * (F.col("na") + F.col("nb") - most) - 1e-9).select("q", "name")


def similar_names(asked: DataFrame, known: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(q, name, similarity) of every different pair of a name of ``asked`` and one of ``known`` whose similarity is above ``threshold``.

    Both have a column ``name``; null names and names without a letter or digit match nothing.
    """
    with scratch(asked.sparkSession) as own:
        sets = lambda df: df.select("name").distinct().select("name", trigrams(F.col("name")).alias("g")).filter("name IS NOT NULL AND size(g) > 0")
        a = stored(sets(asked), "asked")
        if a.limit(FEW + 1).count() <= FEW:
            # few names go to where the known ones are read: no set of a known name is cut up, ordered or stored
            x, y, n = F.col("x"), F.col("g"), F.size("x")
            fits = (n > F.size(y) * threshold - 1e-9) & (F.size(y) > n * threshold - 1e-9)
            met = sets(known).join(F.broadcast(a.toDF("q", "x")), fits & (jaccard(x, y) > threshold))
            return own.result(met.select("q", "name", jaccard(x, y).alias("similarity")), "similar")
        b = stored(sets(known), "known")
        met = candidates(a, b, threshold).join(a.toDF("q", "x"), "q").join(b.toDF("name", "y"), "name")
        found = met.select("q", "name", jaccard(F.col("x"), F.col("y")).alias("similarity"))
        return own.result(found.filter(F.col("similarity") > threshold), "similar")
