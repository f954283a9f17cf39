"""Query of the URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import urls
from tidemark.llm.common import LOWER, UPPER, table

# The rules of the query.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


_HOST, _PATH = (f"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {i}), '')" for i in (1, 2))
_CASES = [(f"(host = '{h}' or host like '%.{h}') and starts_with(path, '/{p}')", kind, text) for kind, text in sorted(RULES, key=lambda r: -len(r[1])) for h, _, p in [text.partition("/")]]
#: Hosts, paths and rules can be said in SQL; the model's verdicts are left out.
SQL = {
    "facts_op9_rules": f"""with u as (select page_id, translate({_HOST}, '{UPPER}', '{LOWER}') as host, {_PATH} as path from pages)
select page_id, host, path, case {' '.join(f"when {c} then '{t}'" for c, _, t in _CASES)} end as rule, case {' '.join(f"when {c} then '{k}'" for c, k, _ in _CASES)} end as ruled from u"""
}


def facts_op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op9_url_filter."""
    return op9_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")
