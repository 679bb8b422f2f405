"""Rules that rows must keep, checked in one pass a table: which of them each row breaks, and a quarantine for those that do.

A check that is null passes, as in SQL. Keys are compared by counts and references by a join on distinct ids, so a hot key is one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.validation import CLAIM_TYPES, ENTITY_TYPES

#: Further enumerations of the tables.
STATUSES = ("pending", "processing", "completed", "failed", "superseded")
MERGES = ("entity_merge", "claim_merge", "artifact_dedup")


def _one_of(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(*values)


def checks(table: str) -> dict[str, Column]:
    """The checks of a table by name: what must hold of each row."""
    sure = lambda c="confidence": F.col(c).between(0, 1)
    there = lambda *names: {f"{n}_missing": F.col(n).isNotNull() for n in names}
    return {
        "entities": {**there("id", "canonical_name"), "entity_type_unknown": _one_of("entity_type", ENTITY_TYPES)},
        "claims": {**there("claim_id", "subject_id", "object_id"), "claim_type_unknown": _one_of("claim_type", CLAIM_TYPES), "confidence_outside": sure(), "window_reversed": F.col("valid_from") <= F.col("valid_to")},
        "evidence": {**there("claim_id", "source_id")},
        "processing_log": {**there("email_id", "extraction_version"), "status_unknown": _one_of("status", STATUSES)},
        "merge_events": {**there("id", "target_id"), "action_unknown": _one_of("action_type", MERGES)},
    }[table]


def broken(rows: DataFrame, must: Mapping[str, Column], key: Sequence[str] = (), references: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """``rows`` with ``broken``, the sorted names of the rules that each breaks.

    ``must``: conditions by name. ``key``: columns that no two rows may share (``key_repeated``; null keys are left to ``must``).
    ``references``: column -> (table, column) that must hold its value (``<column>_unknown``); a null refers to nothing. Columns of ``rows``
    must not be called ``broken`` or begin with ``_``.
    """
    names = rows.columns
    found = [F.when(~condition, F.lit(name)) for name, condition in must.items()]
    if key:
        often = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        rows = rows.join(often, list(key), "left")
        found.append(F.when(F.col("_n") > 1, F.lit("key_repeated")))
    for k, (column, (table, other)) in enumerate((references or {}).items()):
        known = table.select(F.col(other).alias(f"_r{k}")).filter(F.col(f"_r{k}").isNotNull()).distinct()
        rows = rows.join(known, F.col(column) == F.col(f"_r{k}"), "left")
        found.append(F.when(F.col(column).isNotNull() & F.col(f"_r{k}").isNull(), F.lit(f"{column}_unknown")))
    none = F.array().cast("array<string>")
    return rows.select(*names, (F.sort_array(F.array_compact(F.array(*found))) if found else none).alias("broken"))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, without the list; the quarantine, with it)."""
    return checked.filter(F.size("broken") == 0).drop("broken"), checked.filter(F.size("broken") > 0)
