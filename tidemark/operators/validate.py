"""Validation, drop reasons, and the conservation of what was received."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_OPS = ("set", "delete", "add", "remove", "incr")
OPS = (*KEY_OPS, "snapshot_begin", "snapshot_end", "heartbeat")
MAX_KEY_BYTES, MAX_PAYLOAD_BYTES = 4096, 1 << 20


def touches_key(op: Column) -> Column:
    return op.isin(*KEY_OPS)


def problem(op: Column, publisher: Column, member: Column, value: Column, delta: Column, ttl: Column) -> Column:
    """What is wrong with an event, or null: a missing publisher, a negative lifetime, or a field that its operation needs."""
    def missing(what: str) -> Column:
        return F.lit(f"missing_field:{what}")

    return (
        F.when(publisher.isNull() | (publisher == ""), missing("publisher"))
        .when(~F.coalesce(op, F.lit("")).isin(*OPS), "unknown_op")
        .when(ttl < 0, "invalid:ttl")
        .when((op == "set") & value.isNull(), missing("value"))
        .when(op.isin("add", "remove") & F.coalesce(member == "", F.lit(True)), missing("member"))
        .when((op == "incr") & F.coalesce(delta == 0, F.lit(True)), missing("delta"))
    )


def drop_reason(error: Column, invalid: Column, verdict: Column) -> Column:
    """Why an event was not applied, or null if it was: from its decoding error, its validation and its verdict."""
    return (
        F.when(error == "too_large", "too_large").when(error == "unknown_op", "unknown_op").when(error.isNotNull(), "decode_error")
        .when(invalid.isNotNull(), "validation_error").when(verdict == "duplicate", "duplicate").when(verdict == "stale_epoch", "stale_epoch")
    )


def conservation(rows: DataFrame) -> DataFrame:
    """One row: received, applied, dropped, and whether nothing went missing, from rows with a reason."""
    counts = rows.agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("reason").isNull()).alias("applied"), F.count("reason").alias("dropped"))
    return counts.withColumn("holds", F.col("received") == F.col("applied") + F.col("dropped"))
