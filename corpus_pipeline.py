"""A corpus from documents to packed token sequences: toxicity, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet
and read again. All but the last return the columns of documents.

Every stage keeps null texts and empty ones (toxicity scores them as texts without any match, near-duplicate detection
links them with nothing, redaction leaves them, packing makes one end token of them), takes very long texts whole, works on
empty tables, and passes other columns on whatever their names. Null doc_ids are kept; of repeated ones each row counts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_dedup, packing, secrets, toxicity
from tidemark.llm.common import materialize, table

VOCABULARY = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels of these documents."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return near_dedup.survivors(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that holds a secret gives way to a mark; n_chars follows where a text changes."""
    found = secrets.redact(docs.withColumn("__before", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("__before"))
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, each with its sequence and its place there."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), capacity=1024, end=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No SQL for the model, the sketches and the vocabulary; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
