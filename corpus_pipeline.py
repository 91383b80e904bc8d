"""The corpus pipeline: quality rules, line dedup, near copies, benchmark
passages, packing. Each stage takes (spark, docs, sf_dir) and returns the rows
that the next one works on, with all columns of documents but for the last.

Defined results: a null or empty text has no words, so the first stage drops it;
where a stage gets one (a text may lose all its lines), near copies keeps one
empty document, benchmark keeps it, and packing gives its end id. Null languages
and sources are groups like others. A null key is a key like any other, but for
ties: of copies, and of documents with a recurring line, the one of the lowest key
that is not null stays. Repeated rows are copies of each other. An empty table
stays empty from stage to stage, and an empty benchmark drops nothing. Texts of
any length are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavelspark.llm.common import written
from gavelspark.llm.decontamination import decontaminate
from gavelspark.llm.jaccard_join import keep_one
from gavelspark.llm.line_dedup import dedup_lines
from gavelspark.llm.packing import pack_texts
from gavelspark.llm.quality_rules import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across documents."""
    return dedup_lines(docs).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents, in sequences of 2048."""
    import public_tokenizers

    return pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packed)]
#: SQL can't express packing and similarity by hashing; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
