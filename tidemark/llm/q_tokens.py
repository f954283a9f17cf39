"""Queries of the tokenizing operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, packing
from tidemark.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), capacity=1024, end=2)


#: Of packing SQL can say what must hold of any result.
SQL = {"facts_op1_places": "select count(*) as documents, true as fits, true as gapless, true as whole from documents"}


def facts_op1_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether op1_best_fit_packing fills sequences without gaps up to the capacity, and has every document from its first id to its last."""
    rows = op1_best_fit_packing(spark, sf_dir)
    bins = rows.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("p"))
    ends = "aggregate(p, 0L, (at, x) -> if(at = x.offset, at + x.length, -1L)) = fill"
    bins = bins.agg(F.bool_and(F.col("fill") <= 1024).alias("fits"), F.bool_and(F.expr(ends)).alias("gapless"))
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("piece", "start", "length"))).alias("p"))
    docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.bool_and(F.expr("aggregate(p, named_struct('at', 0L, 'n', 0), (a, x) -> if(a.at = x.start and a.n = x.piece, named_struct('at', x.start + x.length, 'n', a.n + 1), named_struct('at', -1L, 'n', -1)), a -> a.at > 0)")).alias("whole"))
    return docs.join(F.broadcast(bins)).select("documents", "fits", "gapless", "whole")  # one row each


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
