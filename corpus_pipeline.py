"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next stage's docs. All but the last keep the columns of documents, whatever their names, and leave their values alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import decontam, mixing, nearsets, tokens, toxicity
from emberline.llm.common import free_name
from emberline.session import remove, scratch, table

#: Near-duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more.
NEAR = {"words": 5, "similarity": 0.8}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model learns from the labelled rows among all documents.

    Null and empty texts hold no evidence and stay; repeated rows, and rows of equal text, share their fate.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = free_name(docs, "score"), free_name(docs, "predicted")
    return toxicity.score(docs, model, names).filter(F.col(names[1]) == 0).select(*docs.columns)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; rows without a doc_id stay.

    Candidates come from SimHash and from MinHash bands, and the exact similarity decides. Null and empty texts are equal, so one of them stays. Rows that share a doc_id are one document: all stay or all go.
    """
    found = nearsets.near_duplicates(docs, **NEAR).filter("doc_id != component_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(found, docs["doc_id"] == found["_copy"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and rows without a doc_id stay.

    Rows that share a doc_id go together where one of them leaks.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of training position, which is the order of the rows written.

    A null source is a source, texts without words are not taken. Rows that share a doc_id share their positions.
    """
    return mixing.training_order(docs).select(*docs.columns)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every copy, as read back from the id files.

    The ids are written in the order of the rows in the files that ``docs`` was read from, the training order; a frame
    that does not come from files is written in ascending doc_id order. A null text is the end id alone.
    """
    if docs.inputFiles():
        file = F.col("_metadata.file_name")
        # by the number of the part: as texts part-100000 would come before part-99999
        return tokens.round_trip(docs, order=(F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long"), file, F.col("_metadata.row_index")))
    return tokens.round_trip(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_ids", to_ids),
]

#: Learned scores and XXH64 fingerprints cannot be expressed in SQL; tests/llm/test_pipeline.py holds each stage
#: against brute force or what was planted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's table is deleted when the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as own:
            docs = own.result(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
            spark._emberline_made.remove(before)
        before = own.kept[0]
    return docs
