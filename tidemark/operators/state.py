"""The expected state of each key: versions, times, lifetimes, settlement, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import projections
from tidemark.operators.sequence import BLOCK, running

RING, NEVER_SETTLED = 16, 10


def effective(events: DataFrame, order: str = "arrival") -> DataFrame:
    """Scalar changes that change something: deleting an absent key is none. Adds prev_op and prev_value.

    In blocks of the order, so that a key with a third of all changes is not one task.
    """
    found = running(events.filter("op in ('set', 'delete')"), ["key"], order, {"__p": F.struct(F.col(order).alias("at"), "op", "value")})
    return found.withColumns({"prev_op": F.col("__p.op"), "prev_value": F.col("__p.value")}).drop("__p").filter("op = 'set' or prev_op = 'set'")


def expected(events: DataFrame, order: str = "arrival", carry: Sequence[str] = (), span: Sequence[str] = ()) -> DataFrame:
    """One row for each key that was ever set: kind (scalar, absent), value, ttl, version, last event and value change, who wrote it last.

    Changes are dealt once, by key and block of the order; each block becomes one row, and a key's blocks are put together. carry: more columns of the last write.
    span: columns of which the least and the greatest value of all changes that count are told, as least_x and greatest_x.
    """
    block = F.floor(F.col(order) / BLOCK)
    inside = Window.partitionBy("key", "__b").orderBy(order)
    rows = events.filter("op in ('set', 'delete')").withColumn("__b", block).withColumn("__p", F.lag(F.struct("op", "value")).over(inside))
    # Within a block: what counts whatever came before it, its first write, and its last.
    write = F.struct("op", "value", "ttl", "seq", "epoch", "publisher", "observed_at", F.col(order).alias("order"), "user_id", *carry, *[F.col(c).alias(f"s_{c}") for c in span])
    ends = [(f"{n}_{c}", f, c) for c in span for n, f in (("least", F.min), ("greatest", F.max))]
    known, inner = (F.col("op") == "set") | (F.col("__p.op") == "set"), F.col("__p").isNotNull()
    changed = known & inner & ((F.col("op") != F.col("__p.op")) | ~F.col("value").eqNullSafe(F.col("__p.value")))
    when = F.when
    blocks = rows.groupBy("key", "__b").agg(
        F.max_by(write, when(known, F.col(order))).alias("l"), F.min_by(write, order).alias("f"), F.max_by(F.struct("op", "value"), order).alias("z"), F.count_if(known).alias("k"),
        F.max(when(changed, F.struct(F.col(order).alias("o"), F.col("observed_at").alias("t")))).alias("c"), F.min(when(known, F.col("observed_at"))).alias("b"), F.max(when(known, F.col("user_id"))).alias("u"),
        *[f(when(known, F.col(c))).alias(n) for n, f, c in ends],
    )
    # The first write of a block follows the last one of the block before: one row for each.
    z = F.lag("z").over(Window.partitionBy("key").orderBy("__b"))
    blocks = blocks.withColumn("z", z)
    fresh = (F.col("f.op") == "delete") & F.coalesce(F.col("z.op") == "set", F.lit(False))
    moved = fresh | ((F.col("f.op") == "set") & (F.col("z").isNull() | (F.col("z.op") != "set") | ~F.col("f.value").eqNullSafe(F.col("z.value"))))
    mark = F.struct(F.col("f.order").alias("o"), F.col("f.observed_at").alias("t"))
    blocks = blocks.select(
        "key", F.coalesce("l", when(fresh, F.col("f"))).alias("w"), (F.col("k") + fresh.cast("long")).alias("k"), F.coalesce("c", when(moved, mark)).alias("c"),
        F.least("b", when(fresh, F.col("f.observed_at"))).alias("b"), F.greatest("u", when(fresh, F.col("f.user_id"))).alias("u"),
        *[(F.least if f is F.min else F.greatest)(n, when(fresh, F.col(f"f.s_{c}"))).alias(n) for n, f, c in ends],
    )
    found = blocks.groupBy("key").agg(F.max_by("w", "w.order").alias("w"), F.sum("k").alias("version"), F.max("c").alias("c"), F.min("b").alias("created_at"), F.max("u").alias("user_id"), *[f(n).alias(n) for n, f, _ in ends]).filter("version > 0")
    return found.select(
        "key", F.when(F.col("w.op") == "set", "scalar").otherwise("absent").alias("kind"), F.when(F.col("w.op") == "set", F.col("w.value")).alias("value"),
        F.when(F.col("w.op") == "set", F.col("w.ttl")).alias("ttl"), "version", "created_at", F.col("w.observed_at").alias("last_event_at"), F.col("c.t").alias("last_change_at"),
        F.col("w.seq").alias("last_seq"), F.col("w.epoch").alias("last_epoch"), F.col("w.publisher").alias("last_publisher"), F.col("w.order").alias("last_order"), "user_id", *[f"w.{c}" for c in carry], *[n for n, _, _ in ends],
    )


def expected_fold(events: DataFrame, shape: str, order: str = "arrival", carry: Sequence[str] = ()) -> DataFrame:
    """expected() for set and counter audits: kind (set, counter, absent) and value as reconcile.sweep() compares it. Each change counts as one of the value."""
    if shape == "set":
        rows = events.filter("op in ('set', 'delete', 'add', 'remove')").withColumn("member", F.when(F.col("op") == "set", F.coalesce("member", "value")).otherwise(F.col("member")))
        found = projections.members(rows, order).groupBy("key").agg(F.to_json(F.array_sort(F.collect_list("member"))).alias("value"))
    else:
        rows = events.filter("op in ('incr', 'delete') or (op = 'set' and try_cast(value as bigint) is not null)")
        found = projections.counter(rows, order).select("key", F.col("value").cast("string").alias("value"))
    last = F.max_by(F.struct("seq", "epoch", "publisher", "observed_at", *carry), order).alias("w")
    seen = rows.groupBy("key").agg(last, F.count(F.lit(1)).alias("version"), F.max(order).alias("last_order"), F.min("observed_at").alias("created_at"), F.max("user_id").alias("user_id"))
    return seen.join(found, "key", "left").select(
        "key", F.when(F.col("value").isNull(), "absent").otherwise(shape).alias("kind"), "value", F.lit(None).cast("long").alias("ttl"), "version", "created_at",
        F.col("w.observed_at").alias("last_event_at"), F.col("w.observed_at").alias("last_change_at"), F.col("w.seq").alias("last_seq"), F.col("w.epoch").alias("last_epoch"),
        F.col("w.publisher").alias("last_publisher"), "last_order", "user_id", *[f"w.{c}" for c in carry],
    )


def plus(at: Column, micros: Column | int) -> Column:
    """A time so many microseconds later."""
    us = micros if isinstance(micros, Column) else F.lit(micros)
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / 1_000_000).cast("decimal(18,6)"))


def expired(rows: DataFrame, now: Column) -> DataFrame:
    """rows with is_expired and kind/value as read at `now`; a lifetime of zero never ends."""
    over = F.coalesce((F.col("ttl") > 0) & (plus(F.col("last_event_at"), F.col("ttl")) < now), F.lit(False)) & (F.col("kind") != "absent")
    return rows.withColumn("is_expired", over).withColumns({"kind": F.when(F.col("is_expired"), "absent").otherwise(F.col("kind")), "value": F.when(~F.col("is_expired"), F.col("value"))})


def settled(rows: DataFrame, now: Column, window_us: int, max_window_us: int, never: float = NEVER_SETTLED) -> DataFrame:
    """rows with is_settled: quiet for a window, or with an unchanged value for ten windows (at most the largest window)."""
    quiet = plus(F.col("last_event_at"), window_us) < now
    steady = plus(F.col("last_change_at"), int(min(never * window_us, max_window_us))) < now
    return rows.withColumn("is_settled", F.coalesce(quiet | steady, F.lit(False)))


def counts(rows: DataFrame, now: Column, window_us: int, never: float = NEVER_SETTLED) -> DataFrame:
    """One row: keys, settled, in flight, never settled, tombstones."""
    old = plus(F.col("created_at"), int(never * window_us)) < now
    return rows.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if("is_settled").alias("settled"), F.count_if(~F.col("is_settled")).alias("in_flight"),
        F.count_if(~F.col("is_settled") & old).alias("never_settled"), F.count_if(F.col("kind") == "absent").alias("tombstones"),
    )


def history(events: DataFrame, n: int = RING, order: str = "arrival") -> DataFrame:
    """The last n effective changes of each key, oldest first (place from 1); ranks are limited before the shuffle."""
    w = Window.partitionBy("key").orderBy(F.desc(order))
    last = effective(events, order).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return last.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(order)).cast("long")).drop("__r")


def adopt(state: DataFrame, store: DataFrame, at: Column) -> DataFrame:
    """state with the store's values taken over: trust adopted, version one more, last event at the given time."""
    taken = store.filter("stored_type = 'string'").select("key", F.col("scalar").alias("__v"))
    both = state.join(taken, "key", "full_outer")
    has = F.col("__v").isNotNull()
    return both.select(
        "key", F.when(has, "scalar").otherwise(F.col("kind")).alias("kind"), F.coalesce("__v", "value").alias("value"),
        (F.coalesce("version", F.lit(0)) + has.cast("long")).alias("version"), F.when(has, at).otherwise(F.col("last_event_at")).alias("last_event_at"), F.when(has, "adopted").otherwise("complete").alias("trust"),
    )


def within_capacity(rows: DataFrame, most: int) -> DataFrame:
    """The most recently written keys, at most so many; ties by key. A top-k, so no task orders them all."""
    return rows.orderBy(F.desc("last_event_at"), "key").limit(most)
