"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.shipping import ship
from tidemark.tables import clean_up, shared_folder, stored

#: The bytes that separate words everywhere in this subpackage: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
BATCH = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of documents or the like. Rows may be long texts, so a batch that goes to Python holds BATCH of them."""
    ship(spark)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(batch)) > BATCH:
        spark.conf.set(batch, BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cuts the lineage: writes to the shared folder and reads again.
materialize = stored


class Names:
    """Gives the columns of a result their names back."""

    def __init__(self, before: list[str]) -> None:
        self.before = before

    def here(self, name: str) -> str:
        """What a column is called meanwhile."""
        return f"c{[c.lower() for c in self.before].index(name.lower())}_"

    def columns(self) -> list:
        return [F.col(f"c{i}_").alias(c) for i, c in enumerate(self.before)]

    def __call__(self, df: DataFrame, *more: str) -> DataFrame:
        return df.select(*self.columns(), *more)


def renamed(df: DataFrame) -> tuple[DataFrame, Names]:
    """df with columns c0_, c1_ and so on, so that no name clashes with those of an operator's own columns."""
    return df.toDF(*[f"c{i}_" for i in range(len(df.columns))]), Names(df.columns)


def free_name(key: str, taken: Sequence[str]) -> str:
    """What a key is called in a result that has columns of these names."""
    return f"{key}_key" if key.lower() in taken else key


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are done; Spark removes them once the JVM has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Run what is inside with these settings of the session, then put back those from before."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A new schema: the fields of schema, then those of ddl."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def crc32_mod(c: Column, n: int) -> Column:
    """crc32 of the value written as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % F.lit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
