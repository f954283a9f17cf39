"""Query of the document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import fingerprints
from tidemark.llm.common import table


#: Lengths and edited texts can be said in SQL, fingerprints not.
SQL = {
    "facts_op4_texts": """with t as (select doc_id, coalesce(text, '') as t from documents),
n as (select *, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as x, length(t) // 2 as h from t)
select doc_id, length(t) as n_chars, sha256(concat(substring(t, 1, length(t) - h), substring(x, 1, h))) as edited_sha256 from n"""
}


def facts_op4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op4_fingerprints."""
    return op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
