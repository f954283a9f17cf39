"""Expected state that is kept: what one batch of changes does to it, and the state after that.

The state is a table with one row for each key (entries) and, for sets, one with a row for each member (members). A batch
is folded for itself first; what it does to a key's value is a small function of the value before: a last write, the last
change of each member, or an addition within limits. So the work of a batch is one pass over its changes and one join with
the state, however many batches there were, and the result is that of folding all changes at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import projections, reconcile
from tidemark.operators.sequence import running

CHANGE = "struct<at:timestamp_ntz,op:string,value:string,member:string,delta:bigint,publisher:string,epoch:bigint,seq:bigint,arrival:bigint>"
ENTRY = (
    "key string, kind string, value string, ttl bigint, version bigint, created_at timestamp_ntz, last_event_at timestamp_ntz, last_change_at timestamp_ntz, last_seq bigint, last_epoch bigint, "
    f"last_publisher string, last_order bigint, user_id bigint, stamp string, writers bigint, ring array<{CHANGE}>"
)
MEMBER = "key string, member string"
COLUMNS = [x.split()[0] for x in ENTRY.split(", ")[:-1]] + ["ring"]


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], ENTRY), spark.createDataFrame([], MEMBER)


def _tails(rows: DataFrame, ring: int) -> DataFrame:
    """key, ring, n, writers: a batch's last changes of each key, oldest first; how many there were, and by how many publishers."""
    change = F.struct(F.col("observed_at").alias("at"), "op", "value", "member", "delta", "publisher", "epoch", "seq", "arrival")
    # Only the newest of each block of the order can be among the newest of all, so no key is one long list.
    blocks = rows.groupBy("key", F.floor(F.col("arrival") / 10_000).alias("b")).agg(F.slice(F.sort_array(F.collect_list(F.struct("arrival", change.alias("c"))), False), 1, ring).alias("l"), F.count(F.lit(1)).alias("n"), F.min("publisher").alias("p"), F.max("publisher").alias("q"))
    whole = blocks.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("l")), False), 1, ring).alias("l"), F.sum("n").alias("n"), F.min("p").alias("p"), F.max("q").alias("q"))
    return whole.select("key", F.transform(F.reverse("l"), lambda x: x["c"]).alias("ring"), "n", F.when(F.col("p") == F.col("q"), 1).otherwise(2).cast("long").alias("writers"))


def _scalars(rows: DataFrame) -> DataFrame:
    """What a batch does to each scalar: its first and its last effective write, how many there were, when the value last changed."""
    rows = running(rows.filter("op in ('set', 'delete')"), ["key"], "arrival", {"__p": F.struct(F.col("arrival").alias("at"), "op", "value")})
    write = F.struct("op", "value", "ttl", "seq", "epoch", "publisher", "observed_at", "stamp", "arrival", "user_id")
    first, known = F.col("__p").isNull(), (F.col("op") == "set") | (F.col("__p.op") == "set")
    changed = ~first & ((F.col("op") != F.col("__p.op")) | ~F.col("value").eqNullSafe(F.col("__p.value"))) & known
    when = lambda c, x: F.when(c, x)
    return rows.groupBy("key").agg(
        F.max_by(write, when(known, F.col("arrival"))).alias("l"), F.min_by(write, "arrival").alias("f"), F.count_if(known).alias("k"),
        F.max_by(when(changed, F.col("observed_at")), when(changed, F.col("arrival"))).alias("c"), F.min(when(known, F.col("observed_at"))).alias("b"),
    )


def _merged_scalars(entries: DataFrame, rows: DataFrame, ring: int) -> DataFrame:
    done = _scalars(rows).join(_tails(rows, ring).select("key", F.col("ring").alias("r"), "n", F.col("writers").alias("w")), "key")
    both = entries.join(done, "key", "full_outer")
    live = F.coalesce(F.col("kind") == "scalar", F.lit(False))
    # A batch's first delete counts if the key was there before it.
    fresh = (F.col("f.op") == "delete") & live
    last = F.coalesce("l", F.when(fresh, F.col("f")))
    moved = F.col("f").isNotNull() & F.when(F.col("f.op") == "set", ~live | ~F.col("value").eqNullSafe(F.col("f.value"))).otherwise(live)
    both = both.withColumns({"last": last, "moved": F.coalesce(moved, F.lit(False)), "fresh": F.coalesce(fresh, F.lit(False))}).filter("kind is not null or last is not null")
    new = F.col("last").isNotNull()
    is_set = F.col("last.op") == "set"
    pick = lambda c, old: F.when(new, c).otherwise(F.col(old)).alias(old)
    return both.select(
        "key", pick(F.when(is_set, "scalar").otherwise("absent"), "kind"), pick(F.when(is_set, F.col("last.value")), "value"), pick(F.when(is_set, F.col("last.ttl")), "ttl"),
        (F.coalesce("version", F.lit(0)) + F.coalesce("k", F.lit(0)) + F.col("fresh").cast("long")).alias("version"), F.least("created_at", "b").alias("created_at"),
        pick(F.col("last.observed_at"), "last_event_at"), F.coalesce("c", F.when(F.col("moved"), F.col("f.observed_at")), "last_change_at").alias("last_change_at"),
        pick(F.col("last.seq"), "last_seq"), pick(F.col("last.epoch"), "last_epoch"), pick(F.col("last.publisher"), "last_publisher"), pick(F.col("last.arrival"), "last_order"),
        F.greatest("user_id", "last.user_id").alias("user_id"), pick(F.col("last.stamp"), "stamp"), _writers(), _ring(ring),
    )


def _writers() -> Column:
    """1 while a key has one publisher, 2 once it had several."""
    other = F.col("last_publisher").isNotNull() & (F.col("last_publisher") != F.get("r", F.lit(0))["publisher"])
    return F.greatest("writers", "w", F.when(other, F.lit(2)).cast("long")).alias("writers")


def _ring(ring: int) -> Column:
    both = F.concat(F.coalesce("ring", F.array().cast(f"array<{CHANGE}>")), F.coalesce("r", F.array().cast(f"array<{CHANGE}>")))
    return F.slice(both, F.greatest(F.size(both) - ring, F.lit(0)) + 1, F.lit(ring)).alias("ring")


def _merged_fold(entries: DataFrame, rows: DataFrame, shape: str, ring: int) -> DataFrame:
    """The same for sets and counters, in which each change counts as one of the value. A set's members are not here."""
    last = F.max_by(F.struct("seq", "epoch", "publisher", "observed_at", "stamp"), "arrival").alias("l")
    done = rows.groupBy("key").agg(last, F.max("arrival").alias("at"), F.min("observed_at").alias("b"), F.max("user_id").alias("u"))
    done = done.join(_tails(rows, ring).select("key", F.col("ring").alias("r"), "n", F.col("writers").alias("w")), "key")
    if shape == "counter":
        done = done.join(projections.counter_effects(rows), "key", "left")
    both = entries.join(done, "key", "full_outer")
    new = F.col("l").isNotNull()
    if shape == "counter":
        before = F.coalesce(F.when(F.col("kind") == "counter", F.col("value").try_cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        after = F.least(F.greatest(before + F.col("f.add"), F.col("f.lo")), F.col("f.hi")).cast("bigint").cast("string")
        # f.dead is null where no change of the batch could be read as a number.
        kind = F.when(F.col("f.dead").isNull(), F.coalesce("kind", F.lit("absent"))).when(F.col("f.dead"), "absent").otherwise("counter")
        value = F.when(F.col("f.dead").isNull(), F.col("value")).when(~F.col("f.dead"), after)
    else:
        kind, value = F.lit("set"), F.lit(None).cast("string")
    pick = lambda c, old: F.when(new, c).otherwise(F.col(old)).alias(old)
    return both.select(
        "key", pick(kind, "kind"), pick(value, "value"), pick(F.lit(None).cast("long"), "ttl"), (F.coalesce("version", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("version"),
        F.least("created_at", "b").alias("created_at"), pick(F.col("l.observed_at"), "last_event_at"), pick(F.col("l.observed_at"), "last_change_at"), pick(F.col("l.seq"), "last_seq"),
        pick(F.col("l.epoch"), "last_epoch"), pick(F.col("l.publisher"), "last_publisher"), pick(F.col("at"), "last_order"), F.greatest("user_id", "u").alias("user_id"), pick(F.col("l.stamp"), "stamp"),
        _writers(), _ring(ring),
    )


def _merged_members(members: DataFrame, rows: DataFrame) -> DataFrame:
    """The members after a batch: only those before its last set or delete of their key go, and of each member its last change counts."""
    resets = rows.filter("op in ('set', 'delete')").select("key").distinct()
    after = projections.members(rows, "arrival").withColumn("__in", F.lit(True))
    out = rows.filter("op = 'remove'").select("key", "member").distinct()
    kept = members.join(resets, "key", "left_anti").join(out, ["key", "member"], "left_anti").withColumn("__in", F.lit(True))
    return kept.unionByName(after).select("key", "member").distinct()


def changes(applied: DataFrame, shape: str) -> DataFrame:
    """The applied events that a shape's fold can take."""
    if shape == "scalar":
        return applied.filter("op in ('set', 'delete')")
    if shape == "set":
        rows = applied.filter("op in ('set', 'delete', 'add', 'remove')")
        return rows.withColumn("member", F.when(F.col("op") == "set", F.coalesce("member", "value")).otherwise(F.col("member")))
    return applied.filter("op in ('incr', 'delete') or (op = 'set' and try_cast(value as bigint) is not null)")


def merged(entries: DataFrame, members: DataFrame, applied: DataFrame, shape: str, ring: int) -> tuple[DataFrame, DataFrame]:
    """entries and members after a batch of applied events (key, op, value, member, delta, ttl, seq, epoch, publisher, observed_at, arrival, stamp, user_id)."""
    rows = changes(applied, shape)
    if shape == "scalar":
        return _merged_scalars(entries, rows, ring), members
    return _merged_fold(entries, rows, shape, ring), _merged_members(members, rows) if shape == "set" else members


def known(entries: DataFrame, members: DataFrame, shape: str, most: int = projections.MAX_MEMBERS) -> DataFrame:
    """entries with the value of sets as their sorted members in JSON, and is_truncated: sets that hold more than so many, of which nothing is said."""
    if shape != "set":
        return entries.withColumn("is_truncated", F.lit(False))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
    listed = members.join(sizes.filter(F.col("__n") <= most).select("key"), "key", "left_semi").groupBy("key").agg(F.to_json(F.array_sort(F.collect_list("member"))).alias("__v"))
    rows = entries.join(sizes, "key", "left").join(listed, "key", "left")
    gone = F.col("__n").isNull()
    return rows.withColumns({"kind": F.when(gone, "absent").otherwise(F.col("kind")), "value": F.col("__v"), "is_truncated": F.coalesce(F.col("__n") > most, F.lit(False))}).drop("__n", "__v")


def adopted(store: DataFrame, shape: str, at: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """entries and members taken over from a store at the start: at most so many keys, the first in their order. They count as unproven until an event writes them."""
    read = reconcile.typed(store, shape).filter("kind not in ('absent', 'wrong_type')")
    read = read.select("key", F.col("kind"), reconcile.shown(shape).alias("value"), *(["members"] if shape == "set" else []))
    read = read.orderBy("key").limit(most)
    null = lambda kind: F.lit(None).cast(kind)
    entries = read.select(
        "key", "kind", (null("string") if shape == "set" else F.col("value")).alias("value"), null("long").alias("ttl"), F.lit(1).cast("long").alias("version"), at.alias("created_at"), at.alias("last_event_at"),
        null("timestamp_ntz").alias("last_change_at"), null("long").alias("last_seq"), null("long").alias("last_epoch"), null("string").alias("last_publisher"), F.lit(-1).cast("long").alias("last_order"),
        null("long").alias("user_id"), F.lit("adopted").alias("stamp"), F.lit(0).cast("long").alias("writers"), F.array().cast(f"array<{CHANGE}>").alias("ring"),
    )
    members = read.select("key", F.explode("members").alias("member")) if shape == "set" else read.select("key", F.col("value").alias("member")).limit(0)
    return entries, members
