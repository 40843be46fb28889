"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallylog.llm.common import written
from tallylog.llm.op1_quality import keep_good
from tallylog.llm.op2_decontaminate import clean
from tallylog.llm.op5_simhash import one_of_near_copies
from tallylog.llm.op8_pieces import encode
from tallylog.llm.op9_lines import dedup_lines


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored like any other; repeated rows and null ids stay as they are."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents share go; a document whose lines all go stays with an empty text, as does one whose text is null."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity of 0.8 or more) stays: the smallest doc_id, null ids last.

    Repeated rows are copies. Texts without words are copies of each other alone.
    """
    return one_of_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Texts and items without words hit nothing."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each document's pieces; none for an empty text."""
    return encode(docs)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("SentencePiece encoding", pieces)]

#: SQL cannot express a fitted classifier, components of near copies or BPE merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *kept, (_, last) = STAGES
    for _, stage in kept:
        docs = written(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
