"""Query of the approximate nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import nearest
from tidemark.llm.common import table


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, k=20)
