"""Ordered folds of changes into values, as aggregates: no step depends on a driver loop or a row-wise function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import saturating

#: Members of a set that are kept; parts that a key's members are ranked in.
MAX_MEMBERS, PARTS = 100_000, 16
REGISTRY: dict[str, Callable[..., DataFrame]] = {}
COMMUTATIVE = {"scalar": False, "set": False, "counter": False, "counter_incr": True}


def register(name: str) -> Callable:
    """Make a fold known by name; a name taken twice is an error."""

    def add(fold: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"projection {name} is registered twice")
        REGISTRY[name] = fold
        return fold

    return add


@register("scalar")
def scalar(events: DataFrame, order: str = "arrival") -> DataFrame:
    """key, op, value, ttl, at: the last write of each key; deleted keys stay as tombstones. Keys that were only deleted do not appear."""
    last = F.max_by(F.struct("op", "value", "ttl"), order).alias("w")
    found = events.filter("op in ('set', 'delete')").groupBy("key").agg(last, F.max(order).alias("at"), F.count_if(F.col("op") == "set").alias("__sets"))
    return found.filter("__sets > 0").select("key", "w.op", "w.value", "w.ttl", "at")


@register("set")
def members(events: DataFrame, order: str = "arrival", delimiter: str = ",") -> DataFrame:
    """key, member: what each set holds after all changes. An empty set has no rows.

    Only what follows a key's last set or delete counts, and of each member only its last change.
    """
    resets = events.filter("op in ('set', 'delete')").groupBy("key").agg(F.max(order).alias("__ri"), F.max_by("op", order).alias("__ro"), F.max_by("member", order).alias("__rm"))
    base = resets.filter("__ro = 'set'").select("key", F.explode(F.split("__rm", delimiter)).alias("member"), F.col("__ri").alias("__i")).filter("member <> ''").withColumn("op", F.lit("add"))
    later = events.filter("op in ('add', 'remove')").join(resets.select("key", "__ri"), "key", "left").filter(F.col(order) > F.coalesce("__ri", F.lit(-1)))
    ops = later.select("key", "member", F.col(order).alias("__i"), "op").unionByName(base.select("key", "member", "__i", "op"))
    return ops.groupBy("key", "member").agg(F.max_by("op", "__i").alias("op")).filter("op = 'add'").select("key", "member")


def as_sets(rows: DataFrame, most: int = MAX_MEMBERS) -> DataFrame:
    """key, members (sorted, at most so many), size, truncated.

    A key's members are ranked in parts, by their hash, so that a very large set is not one task; each part keeps at most so
    many, and only these are put together.
    """
    w = Window.partitionBy("key", "__p").orderBy("member")
    ranked = rows.withColumn("__p", F.pmod(F.xxhash64("member"), F.lit(PARTS))).withColumn("__n", F.row_number().over(w))
    parts = ranked.groupBy("key", "__p").agg(F.collect_list(F.when(F.col("__n") <= most, F.col("member"))).alias("m"), F.max("__n").cast("long").alias("n"))
    found = parts.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("m"))), 1, most).alias("members"), F.sum("n").alias("size"))
    return found.withColumn("truncated", F.col("size") > most)


@register("counter")
def counter(events: DataFrame, order: str = "arrival") -> DataFrame:
    """key, value: the last set value plus the increments after it, or all increments; saturating. A deleted counter has no row until it is written again."""
    ok = events.filter("op in ('incr', 'delete') or (op = 'set' and try_cast(value as bigint) is not null)")
    resets = ok.filter("op <> 'incr'").groupBy("key").agg(F.max(order).alias("__ri"), F.max_by(F.when(F.col("op") == "set", F.col("value").try_cast("long")), order).alias("__base"))
    rows = ok.filter("op = 'incr'").join(resets.select("key", "__ri"), "key", "left").filter(F.col(order) > F.coalesce("__ri", F.lit(-1)))
    sums = rows.groupBy("key").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("__sum"))
    both = sums.join(resets.select("key", "__base"), "key", "full_outer").filter("__sum is not null or __base is not null")
    return both.select("key", saturating(F.coalesce("__sum", F.lit(0)) + F.coalesce("__base", F.lit(0)).cast("decimal(38,0)")).alias("value"))


@register("counter_incr")
def increments(events: DataFrame) -> DataFrame:
    """key, value: the saturating sum of all increments, in any order."""
    return events.filter("op = 'incr'").groupBy("key").agg(saturating(F.sum(F.col("delta").cast("decimal(38,0)"))).alias("value"))


def _limits() -> tuple[str, str, str]:
    d = "decimal(38,0)"
    return d, f"cast('-9223372036854775808' as {d})", f"cast('9223372036854775807' as {d})"


def counter_effects(events: DataFrame, order: str = "arrival", block: int = 10_000) -> DataFrame:
    """key, f: what all changes of a key do to a number, as struct<add, lo, hi, dead>.

    A run of changes adds, then keeps within two limits, so runs can be put together: those of each block of the order
    first, then the blocks of each key. dead: whether nothing is left; null: none of the changes could be read.
    """
    d, lo, hi = _limits()
    made = lambda add, low, high, dead: f"named_struct('add', cast({add} as {d}), 'lo', cast({low} as {d}), 'hi', cast({high} as {d}), 'dead', {dead})"
    kept = lambda x, low, high: f"least(greatest({x}, {low}), {high})"
    same = made(0, lo, hi, "cast(null as boolean)")  # no change yet
    # A set is a number whatever was before; a deleted counter is nothing, and counts from 0 if it is written again.
    own = f"case op when 'delete' then {made(0, 0, 0, 'true')} when 'set' then if(v is null, {same}, {made(0, 'v', 'v', 'false')}) else {made('delta', lo, hi, 'false')} end"
    then = made("a.add + x.f.add", kept("a.lo + x.f.add", "x.f.lo", "x.f.hi"), kept("a.hi + x.f.add", "x.f.lo", "x.f.hi"), "coalesce(x.f.dead, a.dead)")
    fold = f"aggregate(array_sort(collect_list(struct(i, f))), {same}, (a, x) -> {then})"
    ops = events.filter("op in ('incr', 'set', 'delete')").select("key", "op", "delta", F.col("value").try_cast("long").alias("v"), F.col(order).alias("i"), F.floor(F.col(order) / block).alias("b"))
    blocks = ops.withColumn("f", F.expr(own)).groupBy("key", "b").agg(F.expr(fold).alias("f")).withColumnRenamed("b", "i")
    return blocks.groupBy("key").agg(F.expr(fold).alias("f"))


def exact_counter(events: DataFrame, order: str = "arrival", block: int = 10_000) -> DataFrame:
    """key, value: a counter that saturates at every step, not only at the end; for keys near the ends of the range."""
    found = counter_effects(events, order, block)
    return found.filter("not f.dead").select("key", F.expr("cast(least(greatest(f.add, f.lo), f.hi) as bigint)").alias("value"))
