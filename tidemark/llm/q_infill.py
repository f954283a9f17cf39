"""Query of the fill-in-middle transformation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import infill
from tidemark.llm.common import table

_PART = "array_to_string(u[{}:{}], '')"
SQL = {
    "op11_fill_in_middle": f"""with t as (select doc_id, coalesce(text, '') as t, sha256('7:' || cast(doc_id as varchar)) as h from documents),
u as (select *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as u, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3,
    cast('0x' || h[25:32] as bigint) as h4 from t),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b from u),
p as (select *, {_PART.format(1, 'a')} as prefix, {_PART.format('a + 1', 'b')} as middle, {_PART.format('b + 1', 'n')} as suffix,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then concat('<P>', prefix, '<S>', suffix, '<M>', middle) else concat('<S>', suffix, '<P>', prefix, '<M>', middle) end) as output_sha256,
    sha256(t) as restored_sha256 from p"""
}


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "infill.*")
    rows = rows.withColumn("restored", infill.original(F.col("output"), F.col("form")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
