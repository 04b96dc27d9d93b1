"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and its result, written as Parquet, is the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netexp.llm.cluster import Scratch
from netexp.llm.line_dedup import line_dedup
from netexp.llm.mixing import repeat_documents
from netexp.llm.ngram_join import one_of_each_group
from netexp.llm.quality import quality_filter
from netexp.llm.queries import SPM_MODEL
from netexp.llm.spm import sentencepiece_encode


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality sample keeps."""
    return quality_filter(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that stand before."""
    return line_dedup(spark, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the one with the smallest doc_id."""
    return one_of_each_group(spark, docs, k=5, threshold="0.8")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return repeat_documents(spark, docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return sentencepiece_encode(spark, docs, SPM_MODEL)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("source_mix", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The trained classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
