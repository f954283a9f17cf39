"""Query of the near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import near_dedup
from tidemark.llm.common import LOWER, UPPER, table


#: Every pair of documents that share a shingle, and what can be reached over links; for small tables.
SQL = {
    "op8_near_duplicates": f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 75 * (p.n + q.n - k)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as other from documents union select r.doc_id, e.y from r join e on r.other = e.x),
m as (select doc_id, min(other) as component_id from r group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from m left join n using (doc_id)"""
}


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
