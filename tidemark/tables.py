"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What this application has written so far.
written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session (tests) gets one of its own; a cluster's executors could not read that."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: cuts the lineage, so a lost executor costs no more than a read."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    written.append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _delete(spark: SparkSession, tables: list[str]) -> None:
    for name in tables:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables, once nothing reads them any more."""
    _delete(spark, written)
    written.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that are written inside, at its end: for a batch of a stream, whose results are written elsewhere."""
    before = set(written)
    try:
        yield
    finally:
        own = [x for x in written if x not in before]
        written[:] = [x for x in written if x in before]
        _delete(spark, own)


def together(*work: Callable[[], object]) -> list:
    """Run independent steps at the same time, as most of the time of small ones goes on planning; their results, in order."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [x.result() for x in [pool.submit(f) for f in work]]
