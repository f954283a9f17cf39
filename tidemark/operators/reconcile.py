"""Store snapshots against expectations: typed reads, joins, categories, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import compact_duration
from tidemark.tables import stored

# Kinds of disagreement, in the order of reports.
CATEGORIES = ("missing_in_target", "extra_in_target", "value_mismatch", "member_mismatch", "type_mismatch", "ttl_mismatch", "counter_mismatch")
MAX_FINDINGS, MAX_LISTED = 10_000, 20
TTL_TOLERANCE_US = 5_000_000


def typed(store: DataFrame, shape: str) -> DataFrame:
    """key, kind (scalar, set, counter, absent, wrong_type), value/members/counter as the shape of the check reads them; for scalars also ttl, if the store tells lifetimes."""
    t = F.col("stored_type")
    if shape == "scalar":
        return store.select("key", F.when(t == "string", "scalar").otherwise("wrong_type").alias("kind"), F.when(t == "string", F.col("scalar")).alias("value"), "stored_type", *(["ttl"] if "ttl" in store.columns else []))
    if shape == "counter":
        number = F.when(t == "string", F.col("scalar").try_cast("long"))
        return store.select("key", F.when(number.isNotNull(), "counter").otherwise("wrong_type").alias("kind"), number.alias("counter"), "stored_type")
    members = F.when(t == "set", F.array_sort(F.array_distinct("members")))
    kind = F.when(t != "set", "wrong_type").when(F.size(members) > 0, "set").otherwise("absent")
    return store.select("key", kind.alias("kind"), members.alias("members"), "stored_type")


def shown(shape: str) -> Column:
    """The value of a typed read as text: sets as their sorted members in JSON, counters as their digits."""
    return F.to_json("members") if shape == "set" else F.col("counter").cast("string") if shape == "counter" else F.col("value")


def category(e_kind: Column, s_kind: Column, equal: Column, adopted: Column, suppressed: Column) -> Column:
    """What differs between expected and stored, or null. Kinds may be null or absent for a key that is not there."""
    gone, here = F.coalesce(e_kind, F.lit("absent")), F.coalesce(s_kind, F.lit("absent"))
    of_kind = F.when(gone == "scalar", "value_mismatch").when(gone == "set", "member_mismatch").otherwise("counter_mismatch")
    return (
        F.when(here == "wrong_type", F.when((gone == "absent") & adopted, F.lit(None)).otherwise("type_mismatch"))
        .when(gone == "absent", F.when((here == "absent") | adopted, F.lit(None)).otherwise("extra_in_target"))
        .when(here == "absent", F.when(suppressed, F.lit(None)).otherwise("missing_in_target"))
        .when(gone != here, "type_mismatch")
        .when(~equal, of_kind)
    )


def sweep(state: DataFrame, store: DataFrame, shape: str = "scalar", forgiven: Column | None = None, at: Column | None = None, tolerance_us: int | None = None) -> DataFrame:
    """key, category, trust, expected and stored value, version: disagreements of settled keys with what is stored.

    Values of sets are their sorted members as JSON, those of counters their digits. forgiven: which missing keys are none, see suppressed().
    tolerance_us: scalars that agree are also held against the store's lifetimes (ttl: microseconds left when it was read, at `at`; null:
    it does not end), and may differ by so much; None: lifetimes are not compared.
    """
    timed = tolerance_us is not None and shape == "scalar"
    read = typed(store, shape).select("key", F.col("kind").alias("s_kind"), shown(shape).alias("s_value"), *([F.col("ttl").alias("s_ttl")] if timed else []))
    rows = state.filter("is_settled and trust <> 'adopted'").join(read, "key", "left")
    found = rows.withColumn("category", category(F.col("kind"), F.col("s_kind"), F.col("value").eqNullSafe(F.col("s_value")), F.lit(False), F.lit(False) if forgiven is None else forgiven))
    mine, other = F.col("value"), F.col("s_value")
    if timed:
        left = lifetime_left(F.col("ttl"), F.col("last_event_at"), at)
        apart = F.col("category").isNull() & (F.col("kind") == "scalar") & (F.col("s_kind") == "scalar") & ttl_mismatch(left, F.col("s_ttl"), tolerance_us=tolerance_us)
        found = found.withColumn("category", F.when(apart, "ttl_mismatch").otherwise(F.col("category")))
        mine, other = (F.when(F.col("category") == "ttl_mismatch", F.coalesce(F.concat(F.lit("ends in "), compact_duration(t)), F.lit("does not end"))).otherwise(v) for v, t in ((mine, left), (other, F.col("s_ttl"))))
    return found.filter("category is not null").select("key", "category", "trust", mine.alias("expected"), other.alias("stored"), "version", "user_id")


def lifetime_left(ttl_us: Column, last_event_at: Column, at: Column) -> Column:
    """What is left at a time of a lifetime that began with the last event; null if it does not end."""
    return F.when(ttl_us > 0, ttl_us - F.timestamp_diff("MICROSECOND", last_event_at, at))


def extras(store: DataFrame, state: DataFrame) -> DataFrame:
    """Stored keys that nothing is known of; tombstones are known."""
    return store.join(state.select("key"), "key", "left_anti")


def extras_twice(first: DataFrame, second: DataFrame, state: DataFrame) -> DataFrame:
    """Unknown keys of a first look that are still stored, readable and unknown at a second one."""
    again = extras(second.filter("stored_type <> 'other'"), state).select("key")
    return extras(first, state).join(again, "key", "left_semi")


def full(state: DataFrame, store: DataFrame) -> DataFrame:
    """key, category for all keys on either side."""
    read = typed(store, "scalar").select("key", F.col("kind").alias("s_kind"), F.col("value").alias("s_value"))
    rows = state.select("key", "kind", "value").join(read, "key", "full_outer")
    return rows.select("key", category(F.col("kind"), F.col("s_kind"), F.col("value").eqNullSafe(F.col("s_value")), F.lit(False), F.lit(False)).alias("category")).filter("category is not null")


def member_difference(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """key, missing, unexpected (counts, exact) and listings of at most MAX_LISTED members, where two sets differ."""
    e, s = F.coalesce("e", F.array().cast("array<string>")), F.coalesce("s", F.array().cast("array<string>"))
    both = expected.select("key", F.col("members").alias("e")).join(stored.select("key", F.col("members").alias("s")), "key", "full_outer")
    both = both.select("key", F.array_except(e, s).alias("m"), F.array_except(s, e).alias("x")).filter("size(m) + size(x) > 0")
    shown = lambda c: F.array_join(F.slice(F.array_sort(c), 1, MAX_LISTED), ",")
    return both.select("key", F.size("m").cast("long").alias("missing"), F.size("x").cast("long").alias("unexpected"), shown("m").alias("missing_members"), shown("x").alias("unexpected_members"))


def ttl_mismatch(expected_us: Column, stored_us: Column, ignore: bool = False, tolerance_us: int = TTL_TOLERANCE_US) -> Column:
    """Whether lifetimes differ by more than the tolerance; never under the policy that ignores them."""
    if ignore:
        return F.lit(False)
    return (expected_us.isNull() != stored_us.isNull()) | F.coalesce(F.abs(expected_us - stored_us) > tolerance_us, F.lit(False))


def suppressed(policy: str, last_event_at: Column, now: Column, assumed_ttl_us: int) -> Column:
    """Whether a missing key may be taken for one that has run out."""
    if policy != "ignore":
        return F.lit(False)
    return F.timestamp_diff("MICROSECOND", last_event_at, now) > assumed_ttl_us


def report(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trust") == "suspect").alias("suspect"), F.count_if(F.col("trust") != "suspect").alias("alertable"))


def capped(findings: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """The first findings by key, at most so many; counts come from report()."""
    return findings.orderBy("key").limit(most)


def health(info: DataFrame) -> DataFrame:
    """Fields of a store's INFO text (lines of name:value) as columns; absent ones are null."""
    field = lambda n: F.regexp_extract("info", rf"(?m)^{n}:([^\r\n]*)", 1)
    number = lambda n: F.nullif(field(n), F.lit("")).try_cast("long")
    return info.select("id", number("used_memory").alias("used_memory"), number("maxmemory").alias("max_memory"), number("evicted_keys").alias("evicted_keys"), number("expired_keys").alias("expired_keys"), field("role").alias("role"), field("redis_version").alias("version"))


def scan(store: DataFrame, glob_regex: str) -> DataFrame:
    """The distinct keys that match a pattern."""
    return store.filter(F.col("key").rlike(glob_regex)).select("key").distinct()


def ranked(findings: DataFrame) -> DataFrame:
    """findings in a fixed order: by category as listed, then key, with the place.

    They are dealt by ranges of that order and numbered within each; what comes before a range in its category is added, one
    row for each range and category.
    """
    at = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")), F.lit(0).cast("long"))
    # Written once: where the ranges are cut must not change between the two uses.
    rows = stored(findings.withColumn("ordinal", at).repartitionByRange("ordinal", "key").withColumn("__p", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("__m").over(Window.partitionBy("ordinal").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("ordinal", "__p").agg(F.count(F.lit(1)).alias("__m")).select("ordinal", "__p", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("ordinal", "__p").orderBy("key"))
    return rows.withColumn("__n", place).join(sizes, ["ordinal", "__p"]).select(*findings.columns, "ordinal", (F.col("__n") + F.col("__before")).alias("place"))
