"""Query of the license scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import licenses
from tidemark.llm.common import table


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
