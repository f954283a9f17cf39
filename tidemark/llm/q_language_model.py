"""Query of the language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language_model
from tidemark.llm.common import table


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
