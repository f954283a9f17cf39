"""Query of the filter interaction audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import filter_audit
from tidemark.llm.common import table

_FILTERS = "(values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
SQL = {
    "op13_filter_audit": f"""with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from t),
m as (select w.part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (w.doc_id > min(w.doc_id) over (partition by t))::int as mask, coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic
    from w left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) l on l.doc_id = w.doc_id),
c as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, mask),
f as (select * from {_FILTERS} as f(letter, b)),
o as (select concat(f1.letter, f2.letter, f3.letter, f4.letter, f5.letter) as filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] as bits from f f1, f f2, f f3, f f4, f f5
    where f1.b + f2.b + f3.b + f4.b + f5.b = 31 and (f1.b | f2.b | f3.b | f4.b | f5.b) = 31),
s as (select filter_order, step, bits[step] as b, list_sum(bits[1:step - 1])::bigint as before from o, range(1, 6) r(step)),
r as (select c.part, filter_order, step, b, coalesce(sum(n) filter ((mask & (b | coalesce(before, 0))) = 0), 0) as kept, coalesce(sum(n) filter ((mask & b) > 0 and (mask & coalesce(before, 0)) = 0), 0) as removed,
    coalesce(sum(n) filter ((mask & b) > 0 and (mask & coalesce(before, 0)) > 0), 0) as redundant, coalesce(sum(n) filter (mask = b), 0) as unique_fails,
    coalesce(sum(good) filter ((mask & b) > 0 and (mask & coalesce(before, 0)) = 0), 0) as good_lost, coalesce(sum(toxic) filter ((mask & b) > 0 and (mask & coalesce(before, 0)) = 0), 0) as toxic_lost
    from c, s group by c.part, filter_order, step, b)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
    toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, b))::bigint as shapley from r"""
}


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))
