"""Queries over the change stream: sequences, ordering, validation, folds, state, trust."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import projections, sequence, state, trust, validate
from tidemark.plans import base, sql, streams
from tidemark.plans.base import query

V, A = sql.VERDICTS, sql.AUDIT


# Sequences

@query("seq_1_verdicts", V + " select arrival, publisher, epoch, seq, verdict from v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return base.judged(spark, d).select("arrival", "publisher", "epoch", "seq", "verdict")


@query("seq_2_accepted", V + " select publisher, verdict not in ('duplicate', 'stale_epoch') as is_accepted, count(*) as n from v group by 1, 2")
def _(spark, d):
    return base.judged(spark, d).groupBy("publisher", sequence.accepted(F.col("verdict")).alias("is_accepted")).agg(F.count(F.lit(1)).alias("n"))


@query("seq_3_first_seen", V + " select publisher, epoch, seq as first_seq, verdict from v where verdict in ('first_seen', 'after_restart')")
def _(spark, d):
    return base.judged(spark, d).filter("verdict in ('first_seen', 'after_restart')").select("publisher", "epoch", F.col("seq").alias("first_seq"), "verdict")


@query("seq_4_gap_intervals", V + " select publisher, epoch, lo, hi from gaps")
def _(spark, d):
    return sequence.gaps(sequence.current(base.judged_once(spark, d)))


@query("seq_5_late_fills", V + " select publisher, epoch, seq, arrival from v where verdict = 'late_fill'")
def _(spark, d):
    return base.judged(spark, d).filter("verdict = 'late_fill'").select("publisher", "epoch", "seq", "arrival")


@query("seq_6_missing", V + " select publisher, epoch, cast(sum(hi - lo + 1) as bigint) as missing, count(*) as intervals from gaps group by 1, 2")
def _(spark, d):
    return sequence.missing(sequence.gaps(sequence.current(base.judged_once(spark, d))))


@query("seq_7_capped_intervals", V + """, ho as (select *, lo - lag(hi) over (partition by publisher, epoch order by lo) as hole from gaps),
rk as (select *, row_number() over (partition by publisher, epoch order by hole desc nulls last, lo desc) as rk from ho),
run as (select *, sum(case when hole is null or rk < 8 then 1 else 0 end) over (partition by publisher, epoch order by lo) as run from rk)
select publisher, epoch, min(lo) as lo, max(hi) as hi, (select count(*) > 8 from gaps g where g.publisher = run.publisher and g.epoch = run.epoch) as truncated from run group by publisher, epoch, run""")
def _(spark, d):
    return sequence.capped_gaps(sequence.gaps(sequence.current(base.judged_once(spark, d))), 8)


@query("seq_8_restarts", V + " select publisher, cast(sum(case when verdict = 'after_restart' then 1 else 0 end) as bigint) as restarts from v group by 1")
def _(spark, d):
    return base.judged(spark, d).groupBy("publisher").agg(F.count_if(F.col("verdict") == "after_restart").alias("restarts"))


@query("seq_9_implicit_restarts", sql.STREAM + """, i as (select publisher, case when epoch = 2 then seq else seq + 5000 end as seq, arrival from st),
h as (select *, max(seq) over (partition by publisher order by arrival rows between unbounded preceding and 1 preceding) as h from i), rs as (select publisher, min(arrival) as ra from h where h - seq > 1000 and seq < 100 group by 1),
k as (select i.*, case when i.arrival >= ra then ra else 0 end as incarnation from i left join rs using (publisher)),
g as (select *, max(seq) over (partition by publisher, incarnation order by arrival rows between unbounded preceding and 1 preceding) as h, row_number() over (partition by publisher, incarnation, seq order by arrival) as rn, first_value(seq) over (partition by publisher, incarnation order by arrival) as b from k),
w as (select publisher, incarnation, case when incarnation > 0 and arrival = incarnation then 'after_restart' when h is null then 'first_seen' when seq = h + 1 then 'accept' when seq > h + 1 then 'with_gap' when rn = 1 and seq > b then 'late_fill' else 'duplicate' end as verdict from g)
select publisher, verdict, count(*) as n, max(incarnation) as incarnation from w group by 1, 2""")
def _(spark, d):
    # Both epochs of the stream read as one, in which each publisher counts from 1 again.
    rows = base.stream(spark, d).select("publisher", F.lit(1).cast("long").alias("epoch"), F.when(F.col("epoch") == 2, F.col("seq")).otherwise(F.col("seq") + 5000).alias("seq"), "arrival")
    return sequence.verdicts(rows).groupBy("publisher", "verdict").agg(F.count(F.lit(1)).alias("n"), F.max("incarnation").alias("incarnation"))


@query("seq_11_publishers", V + """, top as (select publisher, max(epoch) as epoch, count(*) as events, min(observed_at) as first_seen, max(observed_at) as last_seen, cast(sum(case when verdict = 'after_restart' then 1 else 0 end) as bigint) as restarts from v group by 1)
select t.*, (select max(seq) from v where v.publisher = t.publisher and v.epoch = t.epoch) as high, coalesce((select cast(sum(hi - lo + 1) as bigint) from gaps g where g.publisher = t.publisher and g.epoch = t.epoch), 0) as missing from top t""")
def _(spark, d):
    return sequence.publishers(base.judged_once(spark, d))


@query("seq_12_publisher_cap", V + " select publisher, max(observed_at) as last_seen from v group by 1 order by 2 desc, 1 limit 3")
def _(spark, d):
    seen = base.judged(spark, d).groupBy("publisher").agg(F.max("observed_at").alias("last_seen"))
    return sequence.surviving_publishers(seen, 3)


@query("seq_13_publisher_trust", V + """, top as (select publisher, max(epoch) as epoch from v group by 1)
select t.publisher, case when exists (select 1 from gaps g where g.publisher = t.publisher and g.epoch = t.epoch) then 'suspect' else 'complete' end as trust from top t""")
def _(spark, d):
    return sequence.trusted(sequence.publishers(base.judged_once(spark, d))).select("publisher", "trust")


@query("seq_14_cleared_gaps", V + " select publisher, epoch, lo, hi from gaps where lo > 200")
def _(spark, d):
    # A snapshot that ended at number 200 clears what was missing up to there.
    return sequence.gaps(sequence.current(base.judged_once(spark, d))).filter("lo > 200")


@query("seq_15_clock_skew", V + " select publisher, arg_max(date_diff('microsecond', observed_at, published_at), arrival) as skew_us from v group by 1")
def _(spark, d):
    return sequence.clock_skew(base.judged(spark, d))


# Order

@query("ord_1_reorder_window", V + " select publisher, epoch, seq, arrival, row_number() over (partition by publisher, epoch, arrival // 2000 order by seq, arrival) as place from r")
def _(spark, d):
    w = Window.partitionBy("publisher", "epoch", F.expr("arrival div 2000")).orderBy("seq", "arrival")
    return base.received(spark, d).select("publisher", "epoch", "seq", "arrival", F.row_number().over(w).cast("long").alias("place"))


@query("ord_3_passed_through", V + " select publisher, count(*) as n from v where verdict in ('late_fill', 'duplicate') group by 1")
def _(spark, d):
    return base.judged(spark, d).filter("verdict in ('late_fill', 'duplicate')").groupBy("publisher").agg(F.count(F.lit(1)).alias("n"))


@query("ord_4_canonical_fold", V + f", s as ({sql.SCALARS.format(src='acc')}) select key, max(case when k = 1 then op end) as op, max(case when k = 1 then value end) as value from (select *, row_number() over (partition by key order by event_id desc) as k from s) group by key having count(case when op = 'set' then 1 end) > 0")
def _(spark, d):
    return projections.scalar(streams.as_scalars(base.applied(spark, d)), "event_id").select("key", "op", "value")


@query("ord_5_first_arrivals", V + " select publisher, epoch, seq, min(arrival) as arrival from r group by 1, 2, 3")
def _(spark, d):
    return sequence.first_arrivals(base.received(spark, d)).select("publisher", "epoch", "seq", "arrival")


@query("ord_7_capped_findings", A + " select key, category from findings order by key limit 50")
def _(spark, d):
    from tidemark.operators import reconcile

    return reconcile.capped(base.findings(spark, d), 50).select("key", "category")


@query("ord_8_history", A + " select key, op, value, arrival, row_number() over (partition by key order by arrival) as place from (select *, row_number() over (partition by key order by arrival desc) as k2 from x_e) where k2 <= 16")
def _(spark, d):
    return state.history(streams.as_scalars(base.applied(spark, d))).select("key", "op", "value", "arrival", "place")


# Validation

BAD = """, w as (select arrival, event_id, case when event_id % 101 = 0 then '' else publisher end as publisher, case when event_id % 97 = 0 then 'frob' when event_id % 11 = 0 then 'incr' when event_id % 7 = 0 then 'add' else 'set' end as op,
    case when event_id % 14 = 0 then '' else 'm' end as member, case when event_id % 13 <> 0 then 'x' end as value, event_id % 22 as delta, case when event_id % 89 = 0 then -1 end as ttl from st),
p as (select *, case when publisher = '' then 'missing_field:publisher' when op = 'frob' then 'unknown_op' when ttl < 0 then 'invalid:ttl' when op = 'set' and value is null then 'missing_field:value'
    when op = 'add' and member = '' then 'missing_field:member' when op = 'incr' and delta = 0 then 'missing_field:delta' end as problem from w)"""


def _questionable(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rows = base.stream(spark, d).select(
        "arrival", "event_id", F.when(e % 101 == 0, "").otherwise(F.col("publisher")).alias("publisher"), F.when(e % 97 == 0, "frob").when(e % 11 == 0, "incr").when(e % 7 == 0, "add").otherwise("set").alias("op"),
        F.when(e % 14 == 0, "").otherwise("m").alias("member"), F.when(e % 13 != 0, "x").alias("value"), (e % 22).alias("delta"), F.when(e % 89 == 0, F.lit(-1)).cast("long").alias("ttl"),
    )
    return rows.withColumn("problem", validate.problem(*[F.col(c) for c in ("op", "publisher", "member", "value", "delta", "ttl")]))


@query("val_1_problems", V + BAD + " select event_id, problem from p where problem is not null")
def _(spark, d):
    return _questionable(spark, d).filter("problem is not null").select("event_id", "problem")


@query("val_2_touches_key", V + BAD + " select op, op in ('set', 'delete', 'add', 'remove', 'incr') as touches, count(*) as n from p group by 1, 2")
def _(spark, d):
    return _questionable(spark, d).groupBy("op", validate.touches_key(F.col("op")).alias("touches")).agg(F.count(F.lit(1)).alias("n"))


REASONS = BAD + ", q as (select v.*, p.problem, case when problem is not null then 'validation_error' when verdict in ('duplicate', 'stale_epoch') then verdict end as reason from v join p using (event_id))"


def _reasoned(spark: SparkSession, d: str) -> DataFrame:
    rows = base.judged(spark, d).join(_questionable(spark, d).select("event_id", "problem"), "event_id")
    return rows.withColumn("reason", validate.drop_reason(F.lit(None).cast("string"), F.col("problem"), F.col("verdict")))


@query("val_3_drop_reasons", V + REASONS + " select reason, count(*) as n from q where reason is not null group by 1")
def _(spark, d):
    return _reasoned(spark, d).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("val_4_conservation", V + REASONS + " select count(*) as received, count(*) filter (reason is null) as applied, count(reason) as dropped, true as holds from q")
def _(spark, d):
    return validate.conservation(_reasoned(spark, d))


@query("val_5_decode_suspicion", A + " select key, case when last_order < (select max(event_id * 10) from r where event_id % 53 = 0 and event_id * 100 <= 99 * (select m from mx)) then 'suspect' else 'complete' end as trust from xs")
def _(spark, d):
    rows = base.received(spark, d)
    early = F.col("event_id") * 100 <= rows.agg(F.max("event_id") * 99).scalar()
    bad = rows.filter((F.col("event_id") % 53 == 0) & early).agg(F.max(F.col("event_id") * 10).alias("arrival"))
    floor = trust.floors(base.judged(spark, d).limit(0), errors=bad)
    return trust.effective_trust(base.settled(spark, d), floor).select("key", "trust")


@query("val_6_glob", "select distinct concat('user:', cast(user_id as varchar)) as key from events where regexp_full_match(concat('user:', cast(user_id as varchar)), 'user:[1-3][^/]*7')")
def _(spark, d):
    return base.stream(spark, d).filter(fn.matches_glob(F.col("key"), "user:[1-3]*7")).select("key").distinct()


# Folds

@query("prj_1_key_template", "select concat('store:', event_type, '/', cast(user_id as varchar), '@1') as key, count(*) as n from events group by 1")
def _(spark, d):
    rows = base.stream(spark, d)
    key = fn.key_template("store:{{.Publisher}}/{{.Key}}@{{.Epoch}}", {"Publisher": F.col("publisher"), "Key": F.col("user_id"), "Epoch": F.lit(1)})
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_2_scalar", V + f", s as ({sql.SCALARS.format(src='acc')}), l as (select *, row_number() over (partition by key order by arrival desc) as k, count(case when op = 'set' then 1 end) over (partition by key) as sets from s) select key, op, value, ttl, arrival as at from l where k = 1 and sets > 0")
def _(spark, d):
    return projections.scalar(streams.as_scalars(base.applied(spark, d)))


FOLD = f""", e as ({sql.SETS.format(src='acc')}), rs as (select key, max(arrival) as ri from e where op in ('set', 'delete') group by key),
bs as (select e.key, unnest(string_split(e.member, ',')) as member, e.arrival from e join rs on e.key = rs.key and e.arrival = rs.ri where e.op = 'set'),
ops as (select e.key, e.member, e.arrival, e.op from e left join rs using (key) where e.op in ('add', 'remove') and e.arrival > coalesce(rs.ri, -1) union all select key, member, arrival, 'add' from bs where member <> ''),
mem as (select key, member from (select key, member, arg_max(op, arrival) as lo from ops group by 1, 2) where lo = 'add')"""


@query("prj_3_set_members", V + FOLD + " select key, string_agg(member, ',' order by member) as members, count(*) as size from mem group by key")
def _(spark, d):
    found = projections.as_sets(projections.members(streams.as_sets(base.applied(spark, d))))
    return found.select("key", F.array_join("members", ",").alias("members"), "size")


@query("prj_4_emptied_sets", V + FOLD + " select distinct key from e where key not in (select key from mem)")
def _(spark, d):
    rows = streams.as_sets(base.applied(spark, d))
    return rows.select("key").distinct().join(projections.members(rows), "key", "left_anti")


@query("prj_5_set_resets", V + FOLD + " select distinct key, member from bs where member <> ''")
def _(spark, d):
    rows = streams.as_sets(base.applied(spark, d)).filter("op in ('set', 'delete')")
    return projections.members(rows)


@query("prj_6_set_deletes", V + FOLD + " select key, count(*) as n from e where op = 'delete' group by 1")
def _(spark, d):
    return streams.as_sets(base.applied(spark, d)).filter("op = 'delete'").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("prj_3_set_cap", V + FOLD + ", o as (select *, row_number() over (partition by key order by member) as k, count(*) over (partition by key) as size from mem) select key, string_agg(member, ',' order by member) as members, max(size) as size, max(size) > 2 as truncated from o where k <= 2 group by key")
def _(spark, d):
    found = projections.as_sets(projections.members(streams.as_sets(base.applied(spark, d))), 2)
    return found.select("key", F.array_join("members", ",").alias("members"), "size", "truncated")


COUNT = f", e as ({sql.COUNTERS.format(src='acc')}), rs as (select key, max(arrival) as ri from e where op <> 'incr' group by key), bs as (select e.key, try_cast(e.value as bigint) as b from e join rs on e.key = rs.key and e.arrival = rs.ri)"


@query("prj_7_increments", V + COUNT + " select key, cast(sum(delta) as bigint) as value from e where op = 'incr' group by key")
def _(spark, d):
    return projections.increments(streams.as_counters(base.applied(spark, d)))


@query("prj_8_counter", V + COUNT + """, sm as (select e.key, sum(delta) as s from e left join rs using (key) where op = 'incr' and arrival > coalesce(ri, -1) group by 1)
select key, cast(coalesce(s, 0) + coalesce(b, 0) as bigint) as value from sm full join bs using (key) where s is not null or b is not null""")
def _(spark, d):
    return projections.counter(streams.as_counters(base.applied(spark, d)))


@query("prj_8_counter_exact", V + COUNT + """, sm as (select e.key, sum(delta) as s from e left join rs using (key) where op = 'incr' and arrival > coalesce(ri, -1) group by 1)
select key, cast(coalesce(s, 0) + coalesce(b, 0) as bigint) as value from sm full join bs using (key) where s is not null or b is not null""")
def _(spark, d):
    return projections.exact_counter(streams.as_counters(base.applied(spark, d)))


@query("prj_9_part_quantities", "select concat('part:', cast(l_partkey as varchar)) as key, cast(sum(cast(l_quantity as bigint)) as bigint) as value from lineitem group by 1")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("key"), F.lit("incr").alias("op"), F.col("l_quantity").cast("long").alias("delta"))
    return projections.increments(rows)


@query("prj_10_customer_orders", "select concat('customer:', cast(o_custkey as varchar)) as key, arg_max(o_orderstatus, o_orderkey) as value, max(o_orderkey) as at from orders group by 1")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("key"), F.lit("set").alias("op"), F.col("o_orderstatus").alias("value"), F.lit(None).cast("long").alias("ttl"), F.col("o_orderkey").alias("arrival"))
    return projections.scalar(rows).select("key", "value", "at")


@query("prj_11_shape_check", V + FOLD + ", c as (select key from e where op in ('add', 'remove') intersect select key from e where op = 'set') select key from c")
def _(spark, d):
    rows = streams.as_sets(base.applied(spark, d))
    kinds = rows.groupBy("key").agg(F.bool_or(F.col("op").isin("add", "remove")).alias("m"), F.bool_or(F.col("op") == "set").alias("s"))
    return kinds.filter("m and s").select("key")


# Expected state

@query("orc_1_expected", A + " select key, kind, value, ttl, version, created_at, last_event_at, last_change_at, last_seq, last_epoch, last_publisher, last_order from x")
def _(spark, d):
    return base.expected(spark, d).drop("user_id")


@query("orc_2_versions", A + " select version, count(*) as n from x group by 1")
def _(spark, d):
    return base.expected(spark, d).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@query("orc_3_tombstones", A + " select key, version, last_event_at from x where kind = 'absent'")
def _(spark, d):
    return base.expected(spark, d).filter("kind = 'absent'").select("key", "version", "last_event_at")


@query("orc_4_value_changes", A + " select key, last_change_at from x where last_change_at <> last_event_at")
def _(spark, d):
    return base.expected(spark, d).filter("last_change_at <> last_event_at").select("key", "last_change_at")


@query("orc_5_expired", A + " select key, coalesce(ttl > 0 and last_event_at + to_microseconds(ttl) < now, false) and kind <> 'absent' as is_expired, case when coalesce(ttl > 0 and last_event_at + to_microseconds(ttl) < now, false) then 'absent' else kind end as kind from x, clock")
def _(spark, d):
    return state.expired(base.expected(spark, d), base.clock(spark, d)).select("key", "is_expired", "kind")


@query("orc_6_lookup", A + " select key, value, version from x where key in ('user:8', 'user:46', 'user:7')")
def _(spark, d):
    return base.expected(spark, d).filter("key in ('user:8', 'user:46', 'user:7')").select("key", "value", "version")


@query("orc_8_settled", A + " select key, is_settled from xs")
def _(spark, d):
    return base.settled(spark, d).select("key", "is_settled")


@query("orc_9_counts", A + f" select count(*) as keys, count(*) filter (is_settled) as settled, count(*) filter (not is_settled) as in_flight, count(*) filter (not is_settled and created_at + to_microseconds({10 * sql.WINDOW_US}) < now) as never_settled, count(*) filter (kind = 'absent') as tombstones from xs, clock")
def _(spark, d):
    return state.counts(base.settled(spark, d), base.clock(spark, d), sql.WINDOW_US)


@query("orc_10_adopted", A + """ select key, case when s.scalar is not null then 'scalar' else kind end as kind, coalesce(s.scalar, value) as value, coalesce(version, 0) + case when s.scalar is not null then 1 else 0 end as version,
case when s.scalar is not null then now else last_event_at end as last_event_at, case when s.scalar is not null then 'adopted' else 'complete' end as trust from x full join (select key, scalar from store where stored_type = 'string') s using (key), clock""")
def _(spark, d):
    return state.adopt(base.expected(spark, d), base.store(spark, d), base.clock(spark, d))


@query("orc_11_capacity", A + " select key, last_event_at from x order by last_event_at desc, key limit 100")
def _(spark, d):
    return state.within_capacity(base.expected(spark, d), 100).select("key", "last_event_at")


@query("orc_14_state_dump", A + " select key, kind, value, version from x order by key")
def _(spark, d):
    return base.expected(spark, d).select("key", "kind", "value", "version").orderBy("key")


# Trust

TRUST = """, tr as (select v.*, row_number() over (partition by publisher, epoch, seq order by arrival) = 1 as fresh, first_value(seq) over (partition by publisher, epoch order by arrival) as b from v where verdict <> 'stale_epoch'),
ts_ as (select *, sum(case when fresh and seq >= b then 1 else 0 end) over (partition by publisher, epoch order by arrival) as got, max(seq) over (partition by publisher, epoch order by arrival) as top from tr)"""


@query("tru_1_stamped", V + TRUST + " select arrival, publisher, case when greatest(top, b) - b + 1 - got > 0 then 'suspect' else 'complete' end as trust from ts_")
def _(spark, d):
    return trust.stamped(base.judged(spark, d)).select("arrival", "publisher", "trust")


@query("tru_2_floor", A + " select key, trust from xt")
def _(spark, d):
    return base.with_trust(spark, d).select("key", "trust")


@query("tru_3_pattern", A + " select key, case when regexp_full_match(key, 'user:1[^/]*') then 'suspect' else trust end as trust from xt")
def _(spark, d):
    return trust.mark_pattern(base.with_trust(spark, d), "user:1*").select("key", "trust")


@query("tru_4_triggers", V + " select arrival as \"order\", case when verdict = 'with_gap' then 'seq_gap' else 'restart' end as reason from v where verdict in ('with_gap', 'after_restart')")
def _(spark, d):
    return trust.floors(base.judged(spark, d))


@query("tru_5_scopes", "select distinct event_type as publisher, concat('store/', event_type, '/*') as pattern from events")
def _(spark, d):
    scope = F.regexp_replace(F.lit(trust.scope("@", "store/{{.Publisher}}/*")), "@", F.col("publisher"))
    return base.stream(spark, d).select("publisher").distinct().select("publisher", scope.alias("pattern"))


@query("tru_6_cleared", A + " select key, case when last_order < f and 40000 < f then 'suspect' else 'complete' end as trust from xs, fl")
def _(spark, d):
    clear = spark.range(1).select(F.lit(40000).cast("long").alias("order"))
    judged = base.judged_once(spark, d)
    return trust.effective_trust(base.settled(spark, d), trust.floors(judged), clear).select("key", "trust")


@query("tru_7_multi_writers", V + " select key, count(distinct publisher) as writers from acc group by 1 having count(distinct publisher) > 1")
def _(spark, d):
    return trust.multi_writers(base.applied(spark, d))
