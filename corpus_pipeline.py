"""A corpus pipeline of five stages, each one of the library's operators.

Toxic documents go, one document of each near-duplicate class stays, secrets are masked, sources are mixed
to target weights, and the result is packed into token windows. Every stage works on all rows that its
predecessor kept; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import forest, mixing, packing, secrets, toxicity
from tidemark.llm.queries import labels, tokenizer_path
from tidemark.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the score is learned from the labels outside the test fold."""
    field = toxicity.fit(docs, labels(spark, sf_dir), training=~toxicity.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, field, limit=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    return forest.without_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked credential parts masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mixed(docs, weights=(3, 1, 2), share=1.5, limit=2)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), capacity=1024, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("packing", pack_windows),
]

#: tokenization and learned scores cannot be stated in SQL; the tests hold each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the folder's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
