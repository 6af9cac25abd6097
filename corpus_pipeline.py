"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Each stage takes ``(spark, docs, sf_dir)``. The first four return the columns of ``documents``: toxic documents go, exact copies go, one
document of each near-duplicate group stays, personal data in what is left is replaced by its kind. The last returns the packing plan.
Null columns, empty and long texts, repeated rows, empty tables and further columns are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm import dedup_exact, dedup_near, packing, pii, toxicity
from shotweave.llm.bpe import vocabulary_path
from shotweave.llm.registry import table
from shotweave.llm.scratch import Scratch


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; learned from the labels of documents that are in the input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.train_flag(F.col("doc_id"), 5, 0))
    return toxicity.keep_clean(docs, model)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_exact.exact_dedup(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_near.near_dedup(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; ``n_chars`` follows the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    scratch = Scratch(spark)
    docs, last = table(spark, sf_dir, "documents"), len(STAGES) - 1
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == last:
            return out
        written = scratch.write(out)
        if k:
            scratch.drop(docs)
        docs = written
    return docs
