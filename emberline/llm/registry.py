"""Queries of this subpackage by name, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": q.op1_decontamination,
        "op2_minhash": q.op2_minhash,
        "op3_lm": q.op3_lm,
        "op4_toxicity": q.op4_toxicity,
        "op5_licenses": q.op5_licenses,
        "op6_urls": q.op6_urls,
        "op7_repeats": q.op7_repeats,
        "op8_mixing": q.op8_mixing,
        "op9_simhash": q.op9_simhash,
        "op10_tokens": q.op10_tokens,
        "op11_resample": q.op11_resample,
        "op12_language": q.op12_language,
        "op13_collocations": q.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where DuckDB can express the operator; XXH64, learned models and coders are tested by brute force instead."""
    return {
        "op5_licenses": q.OP5_SQL,
        "op8_mixing": q.OP8_SQL,
        "op13_collocations": q.OP13_SQL,
    }
