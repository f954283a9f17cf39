"""Readers of the store under audit, by name. They only read: nothing in this package writes to a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ttl: microseconds that are left of a key's lifetime when the store is read; null if it does not end, or if the snapshot does not tell.
KIND = "key string, stored_type string, scalar string, members array<string>, ttl bigint"
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Make a reader known by name; a name taken twice is an error."""

    def add(read: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"store {name} is registered twice")
        REGISTRY[name] = read
        return read

    return add


def reader(name: str) -> Callable[..., DataFrame]:
    if name not in REGISTRY:
        raise ValueError(f"unknown store {name}; known are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


@register("file")
def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """key, stored_type, scalar, members, ttl of a store's snapshot.

    Parquet, or lines of JSON (.jsonl) with these fields, are read in parallel, whatever their size. A file .json is one
    object {"scalars": {key: value}, "sets": {key: [member]}, "ttls": {key: microseconds}}, which one task reads: for small stores.
    """
    if path.endswith(".jsonl"):
        return spark.read.schema(KIND).json(path)
    if not path.endswith(".json"):
        return spark.read.schema(KIND).parquet(path)
    whole = spark.read.text(path, wholetext=True)
    part = lambda name, kind: F.explode(F.from_json(F.get_json_object("value", f"$.{name}"), f"map<string,{kind}>"))
    kept = whole.select(part("scalars", "string").alias("key", "scalar")).withColumn("stored_type", F.lit("string"))
    kept = kept.unionByName(whole.select(part("sets", "array<string>").alias("key", "members")).withColumn("stored_type", F.lit("set")), allowMissingColumns=True)
    return kept.join(whole.select(part("ttls", "bigint").alias("key", "ttl")), "key", "left").select("key", "stored_type", "scalar", "members", "ttl")


@register("memory")
def memory(spark: SparkSession, scalars: dict[str, str] | None = None, sets: dict[str, list[str]] | None = None, ttls: dict[str, int] | None = None) -> DataFrame:
    """A small store given as dictionaries, for tests and drills."""
    left = ttls or {}
    rows = [(k, "string", v, None, left.get(k)) for k, v in (scalars or {}).items()] + [(k, "set", None, v, left.get(k)) for k, v in (sets or {}).items()]
    return spark.createDataFrame(rows, KIND)
