"""Queries of what a policy does: order, state kept batch by batch, adoption, expiry, scoped suspicion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ledger, metrics, order, reconcile, sequence, state, trust
from tidemark.plans import base, q_stream, sql, streams
from tidemark.plans.base import query
from tidemark.tables import stored

V, A = sql.VERDICTS, sql.AUDIT


# Order

@query("ord_1_restored_order", f"""with s as (select event_type as publisher, cast(1 + cast(event_id >= 6000 as integer) as bigint) as epoch, event_id * 10 as arrival,
    row_number() over (partition by event_type, event_id >= 6000 order by event_id) as seq from events),
p as (select *, count(*) over w = 2 and (seq // 2) % 10 = 1 as swapped, min(arrival) over w // {order.BLOCK} <> max(arrival) over w // {order.BLOCK} as apart from s window w as (partition by publisher, epoch, seq // 2)),
v as (select publisher, epoch, case when seq = 1 then case when epoch = 1 then 'first_seen' else 'after_restart' end when swapped and apart then case when seq % 2 = 1 then 'with_gap' else 'late_fill' end else 'accept' end as verdict from p)
select publisher, epoch, verdict, count(*) as n from v group by all""")
def _(spark, d):
    """Neighbours that came in the wrong order are judged in the right one, but for those that a block's border parts."""
    rows = base.stream_once(spark, d)
    pair = F.expr("seq div 2")
    both = rows.groupBy("publisher", "epoch", pair.alias("pair")).agg(F.sum("arrival").alias("sum"), F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("pair", pair).join(both, ["publisher", "epoch", "pair"])
    swapped = (F.col("n") == 2) & (F.col("pair") % 10 == 1)
    rows = rows.select("publisher", "epoch", "seq", F.when(swapped, F.col("sum") - F.col("arrival")).otherwise(F.col("arrival")).alias("arrival"), F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz").alias("observed_at"))
    judged = sequence.verdicts(stored(order.reordered(rows), "ordered"))
    return judged.groupBy("publisher", "epoch", "verdict").agg(F.count(F.lit(1)).alias("n"))


# State batch by batch

def _changes(rows: DataFrame) -> DataFrame:
    """The columns that a ledger takes; those that a shape has no use for are null."""
    null = {c: F.lit(None).cast(k) for c, k in (("op", "string"), ("value", "string"), ("member", "string"), ("delta", "long"), ("ttl", "long")) if c not in rows.columns}
    return rows.withColumns({**null, "stamp": F.lit("complete")})


def _by_batches(spark: SparkSession, rows: DataFrame, shape: str, entries: DataFrame | None = None, n: int = 3) -> DataFrame:
    """What is known after the changes came in so many batches, each folded into the state that the one before left."""
    rows = stored(_changes(rows), "changes")
    none, members = ledger.empty(spark)
    entries = none if entries is None else entries
    top = rows.agg(F.max("arrival")).first()[0] or 0
    cuts = [-1000, *[top * i // n for i in range(1, n)], top]
    for lo, hi in zip(cuts, cuts[1:]):
        entries, members = ledger.merged(entries, members, rows.filter((F.col("arrival") > lo) & (F.col("arrival") <= hi)), shape, state.RING)
        entries, members = stored(entries.select(ledger.COLUMNS), "entries"), stored(members, "members") if shape == "set" else members
    return ledger.known(entries, members, shape)


@query("orc_1_state_by_batches", A + """, pw as (select key, min(publisher) <> max(publisher) as several from x_s group by key)
select x.key, kind, value, ttl, version, created_at, last_event_at, last_change_at, last_seq, last_epoch, last_publisher, last_order, case when several then 2 else 1 end as writers from x join pw using (key)""")
def _(spark, d):
    found = _by_batches(spark, streams.as_scalars(base.applied(spark, d)), "scalar")
    return found.select("key", "kind", "value", "ttl", "version", "created_at", "last_event_at", "last_change_at", "last_seq", "last_epoch", "last_publisher", "last_order", F.col("writers").cast("int").alias("writers"))


@query("prj_3_sets_by_batches", V + q_stream.FOLD + """, n as (select key, count(*) as version, max(arrival) as last_order from e group by key), m as (select key, string_agg(member, ',' order by member) as members from mem group by key)
select n.key, case when members is null then 'absent' else 'set' end as kind, members, version, last_order from n left join m using (key)""")
def _(spark, d):
    found = _by_batches(spark, streams.as_sets(base.applied(spark, d)), "set")
    return found.select("key", "kind", F.array_join(F.from_json("value", "array<string>"), ",").alias("members"), "version", "last_order")


@query("prj_8_counters_by_batches", V + q_stream.COUNT + """, sm as (select e.key, sum(delta) as s from e left join rs using (key) where op = 'incr' and arrival > coalesce(ri, -1) group by 1),
n as (select key, count(*) as version from e group by key), w as (select key, cast(coalesce(s, 0) + coalesce(b, 0) as bigint) as value from sm full join bs using (key) where s is not null or b is not null)
select n.key, case when w.value is null then 'absent' else 'counter' end as kind, w.value, version from n left join w using (key)""")
def _(spark, d):
    return _by_batches(spark, streams.as_counters(base.applied(spark, d)), "counter").select("key", "kind", F.col("value").cast("long").alias("value"), "version")


@query("orc_10_promoted", A + f""", e0 as (select key, op, value, arrival from ({sql.SCALARS.format(src='acc')}) union all select key, 'set', scalar, -1000 from store where stored_type = 'string'),
f0 as (select * from (select *, lag(op) over (partition by key order by arrival) as po from e0) where op = 'set' or po = 'set')
select key, case when arg_max(op, arrival) = 'set' then 'scalar' else 'absent' end as kind, case when arg_max(op, arrival) = 'set' then arg_max(value, arrival) end as value, count(*) as version,
    case when max(arrival) = -1000 then 'adopted' else 'complete' end as stamp from f0 group by key""")
def _(spark, d):
    """An audit that starts from what a store holds, and then sees all events: keys that no event writes stay adopted."""
    entries, _ = ledger.adopted(base.store(spark, d), "scalar", base.clock(spark, d), 1_000_000)
    rows = streams.as_scalars(base.applied(spark, d))
    return _by_batches(spark, rows, "scalar", stored(entries.select(ledger.COLUMNS), "adopted")).select("key", "kind", "value", "version", "stamp")


# Expiry

_RUN_OUT = "coalesce(ttl > 0 and last_event_at + to_microseconds(ttl) < now, false)"
ASSUMED_US = 43_200_000_000


@query("dif_5_policies", A + f""", q as (select xt.*, now, s_kind, s_value, case when {_RUN_OUT} then 'absent' else kind end as k2 from xt join clock on true left join sread using (key) where is_settled),
c as (select key, trust, date_diff('microsecond', last_event_at, now) > {ASSUMED_US} as old, case when s_kind = 'wrong_type' then 'type_mismatch' when k2 = 'absent' then case when s_kind is null then null else 'extra_in_target' end
    when s_kind is null then 'missing_in_target' when value is distinct from s_value then 'value_mismatch' end as category from q)
select 'model' as policy, key, category, trust from c where category is not null union all select 'ignore', key, category, trust from c where category is not null and not (category = 'missing_in_target' and old)""")
def _(spark, d):
    """Findings once lifetimes are over at the time of reading, under a policy that models them and one that forgives keys of some age."""
    now = base.clock(spark, d)
    known, kept = base.kept("at_read", lambda: state.expired(base.with_trust(spark, d), now)), base.kept("store", lambda: base.store(spark, d))

    def under(policy: str) -> DataFrame:
        forgiven: Column = reconcile.suppressed(policy, F.col("last_event_at"), now, ASSUMED_US)
        return reconcile.sweep(known, kept, "scalar", forgiven).select(F.lit(policy).alias("policy"), "key", "category", "trust")

    return under("model").unionByName(under("ignore"))


# Scope

@query("tru_5_owned_keys", V + q_stream.TRUST + f""", sp as (select publisher, arrival, case when greatest(top, b) - b + 1 - got > 0 then 'suspect' else 'complete' end as stamp from ts_),
o as (select * replace (concat(publisher, ':', key) as key) from ({sql.SCALARS.format(src='acc')})), oe as (select * from (select *, lag(op) over (partition by key order by arrival) as po from o) where op = 'set' or po = 'set'),
l as (select key, publisher, arrival from oe qualify row_number() over (partition by key order by arrival desc) = 1),
m as (select publisher, max(arrival) as m from v where verdict in ('with_gap', 'after_restart') group by publisher)
select key, l.publisher, case when m.m > l.arrival then 'suspect' else stamp end as trust from l join sp using (publisher, arrival) left join m using (publisher)""")
def _(spark, d):
    """Each publisher owns the keys that begin with its name: what it lost puts its own keys in doubt and no others."""
    owner = "{{.Publisher}}:*"
    judged = base.judged_once(spark, d)
    rows = streams.as_scalars(judged).withColumn("key", F.concat("publisher", F.lit(":"), "key"))
    stamped = stored(trust.stamps(rows), "stamped")
    known = state.expected(stamped.filter(sequence.accepted(F.col("verdict"))), carry=["stamp"])
    found = trust.latest(trust.marks(judged, owner), trust.clears(rows, owner))
    return trust.effective(known, found, owner).select("key", F.col("last_publisher").alias("publisher"), "trust")


# Alerts

@query("alr_2_holding", V + """, h as (select publisher as id, date_trunc('hour', observed_at) as t, count(*) as n, count(*) filter (verdict = 'with_gap') as gaps, count(*) filter (verdict = 'late_fill') as late, count(*) filter (verdict not in ('duplicate', 'stale_epoch')) as ok from v group by all),
a as (select id, t, unnest([{'alert': 'event_loss', 'holds': gaps > 0, 's': 600}, {'alert': 'back_pressure', 'holds': late > 0, 's': 300}, {'alert': 'low_coverage', 'holds': ok / n < 0.8, 's': 900}, {'alert': 'drift_detected', 'holds': n > ok, 's': 300},
    {'alert': 'drift_severe', 'holds': n - ok > 0.01 * n, 's': 300}]) as r from h),
g as (select id, t, r.alert as alert, r.holds as holds, r.s as s, sum(case when r.holds then 0 else 1 end) over (partition by id, r.alert order by t) as run from a)
select id, t as at, alert, min(t) over (partition by id, alert, run) as since, date_diff('microsecond', min(t) over (partition by id, alert, run), t) >= s * 1000000 as fires from g where holds""")
def _(spark, d):
    """What held how long in each publisher's hours: gaps, late numbers, and events that were not applied."""
    judged = base.judged(spark, d)
    hours = judged.groupBy(F.col("publisher").alias("id"), F.date_trunc("hour", "observed_at").cast("timestamp_ntz").alias("at")).agg(
        F.count(F.lit(1)).alias("complete_keys"), F.count_if(F.col("verdict") == "with_gap").alias("gap_rate"), F.count_if(F.col("verdict") == "late_fill").alias("buffer_full_rate"), F.count_if(sequence.accepted(F.col("verdict"))).alias("ok"),
    )
    none = {"eviction_rate": F.lit(0), "reachable": F.lit(True), "connected": F.lit(True), "window_us": F.lit(0), "skipped_rate": F.lit(0)}
    return metrics.holding(hours.withColumns({"coverage": F.col("ok") / F.col("complete_keys"), "divergent": F.col("complete_keys") - F.col("ok"), **none}))


@query("orc_4_repeated_values", V + """, s as (select key, observed_at, arrival, cast(event_id % 2 as varchar) as value, lag(cast(event_id % 2 as varchar)) over (partition by key order by arrival) as pv from acc)
select key, arg_max(observed_at, arrival) as last_event_at, arg_max(case when pv is null or pv <> value then observed_at end, case when pv is null or pv <> value then arrival end) as last_change_at from s group by key having last_change_at <> last_event_at""")
def _(spark, d):
    """Keys whose last writes repeated their value: they changed before they were last written."""
    rows = base.applied(spark, d).withColumns({"op": F.lit("set"), "value": (F.col("event_id") % 2).cast("string"), "ttl": F.lit(None).cast("long")})
    return state.expected(rows).filter("last_change_at <> last_event_at").select("key", "last_event_at", "last_change_at")


# Lifetimes

@query("dif_4_lifetimes_swept", A + """, ls as (select key, value as scalar, case when ttl is not null and user_id % 4 <> 2 then ttl * 1000 - date_diff('microsecond', last_event_at, now) + case user_id % 4 when 0 then 4000000 when 1 then 6000000 else 0 end end as s_left from present, clock),
el as (select xt.*, ttl * 1000 - date_diff('microsecond', last_event_at, now) as e_left from xt, clock where is_settled),
bl as (select el.*, case when ls.key is null then case when kind = 'scalar' then 'missing_in_target' end when kind = 'absent' then 'extra_in_target' when value is distinct from scalar then 'value_mismatch'
    when (e_left is null) <> (s_left is null) or coalesce(abs(e_left - s_left) > 5000000, false) then 'ttl_mismatch' end as category from el left join ls using (key))
select key, category, trust, version from bl where category is not null""")
def _(spark, d):
    """A store that also tells what is left of each key's lifetime: too long by 4 s (agreed to) or 6 s, or without an end."""
    at, u = base.clock(spark, d), F.col("user_id") % 4
    left = reconcile.lifetime_left(F.col("ttl") * 1000, F.col("last_event_at"), at) + F.when(u == 0, 4_000_000).when(u == 1, 6_000_000).otherwise(0)
    store = base.present(spark, d).select("key", F.lit("string").alias("stored_type"), F.col("value").alias("scalar"), F.when(u != 2, left).alias("ttl"))
    known = base.with_trust(spark, d).withColumn("ttl", F.col("ttl") * 1000)
    return reconcile.sweep(known, store, at=at, tolerance_us=reconcile.TTL_TOLERANCE_US).select("key", "category", "trust", "version")
