"""Query of the secret scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import secrets
from tidemark.llm.common import table


_PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", "AKIA[A-Z0-9]+", 20),
    ("hex", "[0-9a-f]+", 24),
)


def _spans(ord_: int, kind: str, pattern: str, least: int) -> str:
    """SQL for doc_id, o, kind, s, e: the matches of a pattern with their places, from what stands between them."""
    p = "'" + pattern.replace("'", "''") + "'"
    value = f"regexp_extract(v, {p}, 2)" if kind == "assign" else "v"
    return f"""select doc_id, {ord_} as o, '{kind}' as kind, e - length(v) as s, e from (select *, sum(length(gap) + length(v)) over (partition by doc_id order by i) as e from
        (select doc_id, unnest(m) as v, unnest(g[:len(m)]) as gap, generate_subscripts(m, 1) as i from (select doc_id, regexp_extract_all(t, {p}) as m, string_split_regex(t, {p}) as g from t)))
        where length({value}) >= {least}"""


#: The base spans alone can be said in SQL.
SQL = {
    "facts_op7_base": "with t as (select doc_id, coalesce(text, '') as t from documents), b as (" + " union all ".join(_spans(i, *x) for i, x in enumerate(_PATTERNS)) + """)
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    sha256(coalesce(string_agg(concat(kind, ':', cast(s as bigint), ':', cast(e as bigint)), ',' order by s, o) filter (kind is not null), '')) as base_sha256
from documents d left join b on b.doc_id = d.doc_id group by d.doc_id"""
}


def facts_op7_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op7_secret_scan."""
    return op7_secret_scan(spark, sf_dir).drop("spans")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "s")
    counts = [F.expr(f"cast(size(filter(s, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k, _ in secrets.BASE]
    written = "concat_ws(',', transform({}, x -> concat_ws(':', x.kind, x.start, x.end)))"
    base = "filter(s, x -> x.kind in ('assign', 'access', 'hex'))"
    return found.select(
        "doc_id", *counts, F.sha2(F.expr(written.format(base)), 256).alias("base_sha256"), F.expr(written.format("s")).alias("spans")
    )
