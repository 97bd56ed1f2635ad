"""A corpus from `documents`: quality rules, near copies, personal data, mixing, segmentation.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage
before. All but the last return the columns of documents. Rows with null or
empty texts go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probanda.llm import mixing, ngram_join, personal_data, quality, segmentation
from probanda.llm.common import written
from probanda.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 or more) stays, the one with the least doc_id."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    return personal_data.masked_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_pieces of each document of the mix."""
    return segmentation.segmented(docs, tokenizer_path("piece_bpe_32k.model")).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("personal data", mask_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", segment),
]

#: Near copies, random rounding and segmentation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
