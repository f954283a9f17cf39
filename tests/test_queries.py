"""Every query against the SQL that says the same, on the smallest tables."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from tidemark.operators import confirm
from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.fixture(scope="module")
def results(spark, request):
    """Columns, types and rows of all queries that are asked for, several at a time: most of the time is planning."""

    def run(name):
        df = registry.queries()[name](spark, DIR)
        return df.columns, df.dtypes, df.collect()

    names = {i.callspec.params["name"] for i in request.session.items if getattr(i, "callspec", None) and "name" in i.callspec.params}
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(run, n) for n in sorted(names)}


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(shown(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(results, db, name):
    columns, types, found = results[name].result()
    assert not any(t in ("void", "array", "struct") for _, t in types)
    if name in SQL:
        other = db.sql(SQL[name])
        assert rows(columns, found) == rows(other.columns, other.fetchall())


@pytest.mark.parametrize("query", ["str_6_outcomes", "str_5_waiting_kept"])
def test_no_finding_is_left_out(spark, monkeypatch, query):
    """The queue of a running audit is bounded; the queries that look at all findings are not."""
    monkeypatch.setattr(confirm.candidates, "__defaults__", (None, 3))
    assert registry.queries()[query](spark, "/root/testdata/sf0.01").count() == 26


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())


def test_flagship(spark):
    assert registry.flagship(spark, DIR).count() > 0
