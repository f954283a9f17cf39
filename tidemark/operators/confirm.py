"""From a first disagreement to a confirmed one: candidates, second looks, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_QUEUE = 10_000


def candidates(findings: DataFrame, waiting: DataFrame | None = None, most: int | None = MAX_QUEUE) -> DataFrame:
    """key, version, category, first_seen: new disagreements, each key's earlier wait kept; the oldest first, at most so many, or all (None), in no order."""
    new = findings.select("key", "version", "category", "first_seen")
    if waiting is not None:
        new = new.join(waiting.select("key"), "key", "left_anti").unionByName(waiting.select("key", "version", "category", "first_seen"))
    return new if most is None else new.orderBy("first_seen", "key").limit(most)


def overflow(findings: DataFrame, waiting: DataFrame | None = None, most: int = MAX_QUEUE) -> DataFrame:
    """dropped: how many disagreements candidates() leaves out, as the queue is full."""
    new = findings.select("key")
    if waiting is not None:
        new = new.join(waiting.select("key"), "key", "left_anti").unionByName(waiting.select("key"))
    return new.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("dropped"))


def outcomes(queue: DataFrame, state: DataFrame, store: DataFrame, apart: DataFrame | None = None) -> DataFrame:
    """queue with an outcome at a later look: key_evicted, oracle_advanced, read_failed, suspect, resolved or confirmed, in this order.

    apart: keys whose lifetimes differ at the later look, though their values may agree.
    """
    now = state.select("key", F.col("version").alias("v2"), F.col("value").alias("e2"), F.col("kind").alias("k2"), F.col("trust").alias("t2"))
    look = store.select("key", F.col("stored_type").alias("type2"), F.col("scalar").alias("s2"))
    rows = queue.join(now, "key", "left").join(look, "key", "left")
    agrees = F.when(F.col("k2") == "absent", F.col("type2").isNull()).otherwise(F.coalesce((F.col("type2") == "string") & F.col("e2").eqNullSafe(F.col("s2")), F.lit(False)))
    if apart is not None:
        rows = rows.join(apart.select("key", F.lit(True).alias("__apart")), "key", "left")
        agrees = agrees & F.col("__apart").isNull()
    outcome = F.when(F.col("v2").isNull(), "key_evicted").when(F.col("v2") != F.col("version"), "oracle_advanced").when(F.col("type2") == "unreadable", "read_failed").when(F.col("t2") == "suspect", "suspect").when(agrees, "resolved").otherwise("confirmed")
    return rows.withColumn("outcome", outcome).select(*queue.columns, "outcome")


def episodes(open_: DataFrame, confirmed: DataFrame, state: DataFrame) -> DataFrame:
    """Open episodes after a sweep: those whose version still stands, and the newly confirmed; the first sight is kept."""
    live = open_.join(state.select("key", "version"), ["key", "version"], "left_semi")
    fresh = confirmed.join(live.select("key"), "key", "left_anti")
    return live.select("key", "version", "category", "first_seen").unionByName(fresh.select("key", "version", "category", "first_seen"))


def episode_counts(before: DataFrame, after: DataFrame, resolved: int) -> DataFrame:
    """One row: opened (new keys) and resolved (departed keys, at most as many as the sweep resolved)."""
    opened = after.join(before.select("key"), "key", "left_anti").agg(F.count(F.lit(1)).alias("opened"))
    gone = before.join(after.select("key"), "key", "left_anti").agg(F.least(F.count(F.lit(1)), F.lit(resolved)).alias("resolved"))
    return opened.join(F.broadcast(gone))


def oldest_age_us(open_: DataFrame, now: Column) -> DataFrame:
    return open_.agg(F.max(F.timestamp_diff("MICROSECOND", F.col("first_seen"), now)).alias("oldest_us"))
