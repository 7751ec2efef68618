"""A corpus pipeline: toxic documents go, one document of each group of copies stays, documents that hold benchmark
passages go, secrets are masked, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narrata.llm import decontaminate, secrets, sentencepiece_bpe, simhash_wide, toxicity
from narrata.llm.common import release_memory, staged, table
from narrata.llm.queries import piece_model


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.7 or more; the model learns from the labels of documents in docs."""
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1)
    release_memory()  # what the driver held of the labelled documents
    return toxicity.drop_toxic(docs, model, 0.7)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by SimHash at a similarity of 0.8 on five-word shingles."""
    return simhash_wide.keep_one(docs, words=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays."""
    return secrets.redact_secrets(docs, length_col="n_chars")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digest and that of the decoded text."""
    rows = sentencepiece_bpe.encode_decode(docs, piece_model(), check=True, outputs=("ids", "digests"))
    return rows.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("sentencepiece encoding", encoding_stage),
]
#: Trained models, fingerprints and token merges can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages leave of documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
