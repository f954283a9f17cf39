"""The SQL that says the same as the queries: shared parts, as text."""

from __future__ import annotations

STREAM = """
with mx as (select max(event_id) as m from events), st as (select event_id * 10 as arrival, event_type as publisher, cast(1 + cast(event_id >= 6000 as integer) as bigint) as epoch, ts as observed_at,
    ts + to_seconds(length(event_type) - 5) as published_at, concat('user:', cast(user_id as varchar)) as key, user_id, event_id,
    row_number() over (partition by event_type, event_id >= 6000 order by event_id) as seq from events),
seen as (select * from st where event_id % 37 <> 0 or event_id * 100 > 99 * (select m from mx)),
r as (select * replace (arrival + case when (event_id // 2) % 10 = 0 and event_id * 100 <= 99 * (select m from mx) then case when event_id % 2 = 0 then 11 else -11 end else 0 end as arrival) from seen
    union all select * replace (event_id * 10 + 10005 as arrival) from seen where event_id % 41 = 0)"""

VERDICTS = STREAM + """,
va as (select *, max(epoch) over (partition by publisher order by arrival rows between unbounded preceding and 1 preceding) as pe from r),
vb as (select *, case when pe is null then 'first_seen' when epoch > pe then 'after_restart' when epoch < pe then 'stale_epoch' end as v0 from va),
vc as (select *, max(seq) over (partition by publisher, epoch order by arrival rows between unbounded preceding and 1 preceding) as h,
    first_value(seq) over (partition by publisher, epoch order by arrival) as base, row_number() over (partition by publisher, epoch, seq order by arrival) as rn
    from vb where v0 is distinct from 'stale_epoch'),
v as (select arrival, publisher, epoch, seq, observed_at, published_at, key, user_id, event_id, coalesce(v0, case when seq = h + 1 then 'accept'
        when seq > h + 1 then 'with_gap' when rn = 1 and seq > base then 'late_fill' else 'duplicate' end) as verdict from vc
    union all select arrival, publisher, epoch, seq, observed_at, published_at, key, user_id, event_id, v0 from vb where v0 = 'stale_epoch'),
acc as (select * from v where verdict not in ('duplicate', 'stale_epoch')),
gb as (select distinct publisher, epoch, seq from vc where seq >= base),
gl as (select *, lag(seq) over (partition by publisher, epoch order by seq) as p from gb),
gaps as (select publisher, epoch, p + 1 as lo, seq - 1 as hi from gl where seq - p > 1)"""

SCALARS = """select *, case when event_id % 10 = 0 then 'delete' else 'set' end as op, case when event_id % 10 <> 0 then concat(publisher, ':', cast(event_id % 100 as varchar)) end as value,
    case when event_id % 7 = 0 then 3600000000 end as ttl from {src}"""
SETS = """select *, case when op = 'set' then concat('m1,,m', cast(event_id % 6 as varchar), ',m1') when op <> 'delete' then concat('m', cast(event_id % 6 as varchar)) end as member from
    (select *, case when event_id % 29 = 0 then 'set' when event_id % 23 = 0 then 'delete' when event_id % 5 = 0 then 'remove' else 'add' end as op from {src})"""
COUNTERS = """select *, case when op = 'incr' then 1 + event_id % 9 end as delta, case when op = 'set' then cast(event_id % 1000 as varchar) end as value from
    (select *, case when event_id % 50 = 0 then 'set' when event_id % 61 = 0 then 'delete' else 'incr' end as op from {src})"""


def state(src: str, name: str) -> str:
    """CTEs that end in one row for each key, from scalar changes."""
    changed = "prev_op is null or op <> prev_op or value is distinct from prev_value"
    return f""",
{name}_s as ({SCALARS.format(src=src)}),
{name}_e as (select * from (select *, lag(op) over (partition by key order by arrival) as prev_op, lag(value) over (partition by key order by arrival) as prev_value from {name}_s) where op = 'set' or prev_op = 'set'),
{name}_l as (select * from (select *, row_number() over (partition by key order by arrival desc) as k from {name}_e) where k = 1),
{name}_a as (select key, count(*) as version, min(observed_at) as created_at, arg_max(case when {changed} then observed_at end, case when {changed} then arrival end) as last_change_at, max(user_id) as user_id from {name}_e group by key),
{name} as (select l.key, case when l.op = 'set' then 'scalar' else 'absent' end as kind, case when l.op = 'set' then l.value end as value, case when l.op = 'set' then l.ttl end as ttl, a.version, a.created_at,
    l.observed_at as last_event_at, a.last_change_at, l.seq as last_seq, l.epoch as last_epoch, l.publisher as last_publisher, l.arrival as last_order, a.user_id from {name}_l l join {name}_a a using (key))"""


STORE = state("st", "true_") + """,
present as (select * from true_ where kind = 'scalar'),
store as (select key, case when user_id % 13 = 6 then 'other' else 'string' end as stored_type, case when user_id % 11 = 5 then concat(value, '!') else value end as scalar, user_id from present where user_id % 7 <> 3
    union all select concat('user:', cast(user_id + 1000000 as varchar)), 'string', value, user_id from present where user_id % 17 = 0),
store2 as (select key, case when user_id % 13 = 6 then 'other' else 'string' end as stored_type, case when user_id % 11 = 5 then concat(value, '!') else value end as scalar, user_id from present where user_id % 7 <> 3 or user_id % 14 = 3
    union all select concat('user:', cast(user_id + 1000000 as varchar)), 'string', value, user_id from present where user_id % 34 = 0)"""

#: Six hours; the longest window is ten days. The clock stands ten seconds behind the last event.
WINDOW_US, MAX_WINDOW_US = 21_600_000_000, 864_000_000_000
AUDIT = VERDICTS + state("acc", "x") + STORE + f""",
clock as (select max(ts) + interval 10 second as now from events),
xs as (select x.*, coalesce(last_event_at + to_microseconds({WINDOW_US}) < now or last_change_at + to_microseconds({min(10 * WINDOW_US, MAX_WINDOW_US)}) < now, false) as is_settled from x, clock),
fl as (select max(arrival) as f from v where verdict in ('with_gap', 'after_restart')),
xt as (select xs.*, case when last_order < f then 'suspect' else 'complete' end as trust from xs, fl),
sread as (select key, case when stored_type = 'string' then 'scalar' else 'wrong_type' end as s_kind, case when stored_type = 'string' then scalar end as s_value, stored_type from store),
swept as (select t.*, s_kind, s_value, case when s_kind = 'wrong_type' then 'type_mismatch' when t.kind = 'absent' then case when s_kind is null then null else 'extra_in_target' end
    when s_kind is null then 'missing_in_target' when t.value is distinct from s_value then 'value_mismatch' end as category from xt t left join sread using (key) where is_settled),
findings as (select key, category, trust, value as expected, s_value as stored, version, user_id from swept where category is not null)"""
