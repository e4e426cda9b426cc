"""A corpus pipeline over documents: filter, drop exact and near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the
shared folder and read again as the next one's docs. Language-independent
statistics, samples and thresholds are computed on what the stage is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakespan.llm import bpe, exact_dedup, mixing, near_dedup, quality
from lakespan.llm.queries import tokenizer_path
from lakespan.sources import scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality model, fitted on the labelled ones, rejects."""
    return quality.kept(docs, quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, linked at a similarity of 0.75 of five-word shingles, the smallest doc_id stays."""
    return near_dedup.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files ordered by their slots in the Pfair schedule of the sources."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document, as counts and digests."""
    return bpe.encoded(docs, tokenizer_path(), digests=True).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources", mixed_sources),
    ("BPE encoding and decoding", encoded),
]

#: The classifier is fitted by numpy, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; what earlier stages wrote is deleted as soon as the next one is written."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.written(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.clear(spark, start, keep=(f"stage{k}",))
    return docs
