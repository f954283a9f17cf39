"""Perturbations of a stream, the same for the same input: for tests and drills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_every(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.filter(F.col(column) % n != 0)


def drop_range(rows: DataFrame, column: str, lo: int, hi: int) -> DataFrame:
    return rows.filter(~F.col(column).between(lo, hi))


def drop_share(rows: DataFrame, column: str, share: float, seed: int = 1) -> DataFrame:
    """rows without a share of them, chosen by a seeded hash of the column: the same for the same seed."""
    drawn = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string"))), F.lit(8)), 16, 10).cast("long")
    return rows.filter(drawn % 1_000_000 >= int(share * 1_000_000))


def duplicate(rows: DataFrame, column: str, n: int, later: int) -> DataFrame:
    """Every n-th row again, so much later in the order of arrival."""
    return rows.unionByName(rows.filter(F.col(column) % n == 0).withColumn("arrival", F.col("arrival") + later))


def swap(rows: DataFrame, column: str, n: int, step: int) -> DataFrame:
    """Every n-th pair of neighbours swapped in the order of arrival."""
    pair = F.floor(F.col(column) / 2) % n == 0
    return rows.withColumn("arrival", F.col("arrival") + F.when(pair, F.when(F.col(column) % 2 == 0, step + 1).otherwise(-step - 1)).otherwise(0))


def delay(rows: DataFrame, publisher: str, by: int) -> DataFrame:
    return rows.withColumn("arrival", F.col("arrival") + F.when(F.col("publisher") == publisher, by).otherwise(0))


def partition(rows: DataFrame, publisher: str, lo: int, hi: int) -> DataFrame:
    """Nothing of one publisher arrives between two moments."""
    return rows.filter(~((F.col("publisher") == publisher) & F.col("arrival").between(lo, hi)))


def corrupt(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.withColumn("payload", F.when(F.col(column) % n == 0, F.concat(F.lit("\x00"), "payload")).otherwise(F.col("payload")))


def truncate(rows: DataFrame, column: str, n: int, length: int) -> DataFrame:
    return rows.withColumn("payload", F.when(F.col(column) % n == 0, F.left("payload", F.lit(length))).otherwise(F.col("payload")))


def oversize(rows: DataFrame, column: str, n: int, length: int) -> DataFrame:
    return rows.withColumn("payload", F.when(F.col(column) % n == 0, F.concat("payload", F.repeat(F.lit(" "), length))).otherwise(F.col("payload")))


def skew(rows: DataFrame, publisher: str, micros: int) -> DataFrame:
    shifted = F.timestamp_add("MICROSECOND", F.lit(micros), F.col("published_at"))
    return rows.withColumn("published_at", F.when(F.col("publisher") == publisher, shifted).otherwise(F.col("published_at")))


def restart(rows: DataFrame, publisher: str, from_seq: int, new_epoch: bool) -> DataFrame:
    """From a number on a publisher counts from 1 again, in a new epoch or in the old one."""
    late = (F.col("publisher") == publisher) & (F.col("seq") >= from_seq)
    rows = rows.withColumn("__late", late)
    moved = rows.withColumn("seq", F.when(F.col("__late"), F.col("seq") - (from_seq - 1)).otherwise(F.col("seq")))
    return (moved.withColumn("epoch", F.col("epoch") + F.col("__late").cast("long")) if new_epoch else moved).drop("__late")
