"""From raw documents to packed training windows, one written stage after another.

Every stage works on all that the one before kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywatch.llm import decontam, jaccard, lines, packing, toxicity
from tallywatch.llm.common import stage
from tallywatch.llm.queries import vocabulary

VOCABULARY = "word_bpe_49k.json"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; learns from the labels of the folder and the texts of ``docs``."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches are cut out; ``n_chars`` follows. Documents left empty go."""
    return lines.remove_lines(docs, percent=80)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the similarity of their five-word shingles the one with the smallest id stays."""
    return jaccard.first_of_each(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of 4,096 tokens as pieces of documents, with their ids."""
    return packing.pack(docs, vocabulary(VOCABULARY), window=4096)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None  # learning, and tokens of a vocabulary file, are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
