"""The corpus pipeline: quality selection, line dedup, near-dedup, decontamination, packing.

Every stage works on all that its predecessor kept, written as Parquet in the shared folder and read again. In all of them a null text has
no words and no lines and stays, rows with a null id are judged by what the operator can say without one, extra columns pass through whatever
their names, an empty table gives an empty one, and ties go to the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.decontaminate import find_contamination
from tallyspark.llm.line_dedup import ALONE, dedup_lines
from tallyspark.llm.minhash import near_duplicates
from tallyspark.llm.packing import pack
from tallyspark.llm.quality import filter_by_importance
from tallyspark.llm.queries import encoder
from tallyspark.llm.shared import keep


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample keeps; the labels' low-quality share goes, and documents with toxic words. Rows are judged each
    for itself, with a null id too; rows that tie with the last one kept stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("good"), "toxic")
    return filter_by_importance(docs, labels)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks, and lines of many words, that earlier documents have; those left without any line go.
    Rows with a null id lose nothing; rows that repeat an id are not compared with each other."""
    found = dedup_lines(docs, alone=ALONE)
    left = found.where("n_removed = 0 or n_removed < n_lines")
    return left.select(*(F.char_length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id. Rows with a null id stay; rows that repeat an id stay if one of
    them is kept, since an id names them all."""
    found = near_duplicates(docs, shingle=5, percent=80)
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages. Rows with a null id stay; rows that repeat an id go if one of them is
    contaminated."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.where("contaminated").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 1024 tokens. Every row is a document of its own, with a null id too; a null text is the
    separator alone; pieces of equal length are placed in the order of the rows."""
    return pack(docs, encoder, capacity=1024, end_id=0)


STAGES = [("quality", select_quality), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("pack", pack_sequences)]
#: SQL cannot express these stages; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
