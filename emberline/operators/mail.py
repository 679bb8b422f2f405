"""The signal filter: which messages are worth reading closely."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of folder paths that are skipped.
SKIP_FOLDERS = ("all_documents", "deleted_items", "notes_inbox", "contacts", "calendar", "straw")
#: Keywords, as substrings of the lower-cased subject and body.
KEYWORDS = (
    "skilling", "lay", "fastow", "causey", "kopper", "delainey", "whalley", "kean", "haedicke", "shankman", "kaminski", "ljm", "raptor", "spe", "azurix",
    "dabhol", "blockbuster", "broadband", "ews", "ees", "enron", "andersen", "mark-to-market", "mark to market", "restatement", "10-k", "10k", "earnings",
    "sec", "lawsuit", "settlement", "audit", "accounting", "board", "directors", "shareholders", "approve", "approved", "agreed", "decided", "signed",
    "merger", "acquisition", "deal", "contract", "transaction", "hired", "fired", "resigned", "promoted", "appointed", "loss", "exposure", "hedge",
    "risk", "write-down", "writedown", "collateral", "credit", "debt", "liability",
)
LEAST = 50


def drop_reason(folder: Column, subject: Column, body: Column, keywords: Sequence[str] = KEYWORDS, hits: int = 2) -> Column:
    """'folder', 'length' or 'signal' for what is dropped, in that order; null for what passes. Nulls count as empty."""
    folder, subject, body = (F.coalesce(c, F.lit("")) for c in (folder, subject, body))
    skipped = F.lit(False)
    for part in SKIP_FOLDERS:
        skipped = skipped | F.lower(folder).contains(part)
    line = F.lower(F.concat(subject, F.lit(" "), body))
    # the line is the one element of an array, so that it is made once and not once a keyword
    met = lambda x: sum((F.contains(x, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    found = F.element_at(F.transform(F.array(line), met), 1)
    short = F.length(F.btrim(body, F.lit(" \t\n\x0b\f\r"))) < LEAST
    return F.when(skipped, "folder").when(short, "length").when(found < hits, "signal")


def filter_stats(reasons: DataFrame) -> DataFrame:
    """One row of counts over a column ``reason``: input, passed, dropped_folder, dropped_length, dropped_signal, reduction_pct."""
    r = F.col("reason")
    n, passed = F.count(F.lit(1)), F.count_if(r.isNull())
    dropped = [F.count_if(F.coalesce(r == k, F.lit(False))).alias(f"dropped_{k}") for k in ("folder", "length", "signal")]
    return reasons.agg(n.alias("input"), passed.alias("passed"), *dropped, F.round(100 * (1 - passed / F.greatest(n, F.lit(1))), 1).alias("reduction_pct"))
