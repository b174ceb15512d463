"""A training corpus in five stages, each the whole work of one operator; every stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborfold.llm import decontam, jaccard, mixing, packing, quality
from arborfold.llm._shared import saved


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text rejects go.

    Null and empty texts have nothing to judge and stay; repeated rows are judged alike, so all of them stay or go; a null
    doc_id is judged by its text; a null lang counts as the empty name; a score at the limit stays; long texts are scored
    whole; without labels nothing is rejected; an empty table gives an empty one; other columns are kept as they are.
    """
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, and of its rows one.

    Null and empty texts link with nothing, so all stay; repeated rows are a group; a null doc_id counts as the largest,
    and of several null ones the least hash of the text stays; whole texts are compared, however long; a pair at 0.8
    exactly links; an empty table gives an empty one; other columns are kept as they are.
    """
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its text.

    Null and empty texts hold nothing and stay; so do all if the benchmark is empty; null items are no items; repeated
    rows go or stay together; whole texts are searched, however long; ties don't arise; an empty table gives an empty
    one; other columns are kept as they are.
    """
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, weighted by domain; no document more than once.

    Texts without words cost nothing and stay if they stand within their leaf's prefix; null lang and source count as the
    empty name; in the seeded order of a leaf ties go by doc_id and text, and equal rows stay or go together; a long text
    is taken whole or not at all; an empty table gives an empty one; other columns are kept as they are.
    """
    return mixing.mixed_documents(docs, {("d0",): 2}, (9, 10), 1, 17)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of 2048 token ids.

    Null and empty texts are packed by their end id alone; a long text is split without loss over rows of its own and a last part; repeated
    rows and null doc_ids are packed like others; of rows with equal room the first is filled; an empty table gives
    none; other columns are not part of the result.
    """
    return packing.pack_tokens(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mixing_sources),
    ("token ids", token_ids),
]

#: A language model's perplexity and best-fit packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
