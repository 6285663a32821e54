"""The corpus pipeline: documents that a quality classifier keeps, one of each near-duplicate group, without personal
data, mixed to target weights by source, packed into training sequences.

Each stage gets the whole table its predecessor left, as ``docs``, and returns the columns of documents; the last one
returns the packed pieces. Between stages the table is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import mixing, packing, pii, quality, simhash
from loomwork.llm._common import staged, tokenizer_path
from loomwork.llm.tokens import BYTE_BPE


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, predicts as good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep_good(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return simhash.one_of_each_group(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows the new text."""
    return pii.pseudonymised_documents(docs, key=pii.key_of(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path(BYTE_BPE))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", replace_personal_data),
    ("mixing", mix),
    ("best-fit packing", pack),
]

#: Neither the classifier nor the fingerprints can be written in DuckDB's SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{n}")
    return docs
