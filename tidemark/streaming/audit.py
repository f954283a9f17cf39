"""A continuous audit: each micro-batch goes through the batch operators and updates tables of a folder.

The expectation is kept as one Parquet table for each batch of changes, of each key the last one of the batch, so a batch
that is run again after a failure writes the same files and nothing is counted twice. watch.py has the whole audit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import projections


class Audit:
    """Folds a stream of scalar changes (key, op, value, ttl, arrival) into a table, and hands each batch's state to subscribers."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.paused = spark, folder.rstrip("/"), False
        self.subscribers: list[Callable[[DataFrame, int], None]] = []

    def subscribe(self, f: Callable[[DataFrame, int], None]) -> None:
        self.subscribers.append(f)

    def state(self, through: int | None = None) -> DataFrame | None:
        """The last write of each key after all batches so far, or up to one of them."""
        try:
            log = self.spark.read.parquet(f"{self.folder}/log")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return projections.scalar(log if through is None else log.filter(F.col("batch") <= through))

    def batch(self, rows: DataFrame, number: int) -> None:
        """One micro-batch: only the last write of a key in the batch is kept, which is all that later folds need."""
        last = F.max_by(F.struct("op", "value", "ttl"), "arrival").alias("w")
        small = rows.filter("op in ('set', 'delete')").groupBy("key").agg(last, F.max("arrival").alias("arrival"), F.max((F.col("op") == "set").cast("int")).alias("__set"))
        # A key that was set and deleted within the batch keeps a mark of the set, so that its tombstone is known.
        kept = small.select("key", "w.op", "w.value", "w.ttl", "arrival")
        marks = small.filter("__set = 1 and w.op = 'delete'").select("key", F.lit("set").alias("op"), F.lit("").alias("value"), F.lit(None).cast("long").alias("ttl"), (F.col("arrival") - 1).alias("arrival"))
        kept.unionByName(marks).write.mode("overwrite").parquet(f"{self.folder}/log/batch={number}")
        if not self.paused and self.subscribers:
            found = self.state(number)
            for f in self.subscribers:
                f(found, number)

    def start(self, changes: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.batch)
        return (writer.trigger(availableNow=True) if once else writer).start()


class Lifecycle:
    """The phase of an audit, from what has happened to it."""

    def __init__(self, bootstrap: str = "Adopt") -> None:
        if bootstrap not in ("Adopt", "Wait", "Strict"):
            raise ValueError(f"unknown bootstrap {bootstrap}")
        self.awaiting = bootstrap == "Strict"
        self.started = self.paused = self.failed = self.saturated = False
        self.connected = True

    def snapshot_end(self) -> None:
        self.awaiting = False

    @property
    def phase(self) -> str:
        if not self.started:
            return "Pending"
        for on, name in ((self.paused, "Paused"), (self.awaiting, "AwaitingSnapshot"), (self.failed, "Failed"), (not self.connected or self.saturated, "Degraded")):
            if on:
                return name
        return "Watching"
