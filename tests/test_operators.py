"""Operators against small sequential versions, on random streams."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import projections, sequence, state, trust
from tidemark.operators.sequence import Tracker
from tidemark.plans import streams as changes

EVENT = "publisher string, epoch long, seq long, arrival long"


def made(rng, n, restarts=False):
    rows, epoch, seq = [], 1, rng.randint(1, 5)
    for i in range(n):
        if restarts and rng.random() < 0.03:
            epoch, seq = epoch + 1, 1
        if rng.random() > 0.1:
            rows.append((epoch, seq))
        seq += 1
    for _ in range(n // 8):
        rows.append(rng.choice(rows))
    for _ in range(n // 4):
        i = rng.randrange(len(rows) - 1)
        rows[i], rows[i + 1] = rows[i + 1], rows[i]
    return rows


@pytest.fixture(scope="module")
def streams():
    rng = random.Random(4)
    return {f"p{k}": made(rng, 60, k % 2 == 1) for k in range(20)}


@pytest.fixture(scope="module")
def events(spark, streams):
    return spark.createDataFrame([(p, e, s, i) for p, rows in streams.items() for i, (e, s) in enumerate(rows)], EVENT)


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_verdicts_equal_a_tracker(streams, events, block):
    got = {(r.publisher, r.arrival): r.verdict for r in sequence.verdicts(events, block).collect()}
    for p, rows in streams.items():
        t = Tracker()
        for i, (e, s) in enumerate(rows):
            assert got[p, i] == t.observe(e, s), (p, i)


@pytest.mark.parametrize("block", [5, 1_000_000])
def test_gaps_are_the_numbers_that_never_came(streams, events, block):
    live = sequence.verdicts(events).filter("verdict <> 'stale_epoch'")
    got = {}
    for r in sequence.gaps(live, block).collect():
        got.setdefault((r.publisher, r.epoch), set()).update(range(r.lo, r.hi + 1))
    for p, rows in streams.items():
        t, seen, base = Tracker(), {}, {}
        for e, s in rows:
            if t.observe(e, s) != "stale_epoch":
                base.setdefault(e, s)
                seen.setdefault(e, set()).add(s)
        for e in seen:
            high = {s for s in seen[e] if s >= base[e]}
            assert got.get((p, e), set()) == set(range(base[e], max(high) + 1)) - high


def test_trust_at_each_write(streams, events):
    got = {(r.publisher, r.arrival): r.trust for r in trust.stamped(sequence.verdicts(events)).collect()}
    for p, rows in streams.items():
        t = Tracker()
        for i, (e, s) in enumerate(rows):
            if t.observe(e, s) != "stale_epoch":
                assert got[p, i] == ("suspect" if t.gaps else "complete"), (p, i)


def test_restarts_within_an_epoch(spark):
    rng = random.Random(5)
    sent = {"a": [(1, s) for s in range(1, 1500)] + [(1, s) for s in range(1, 50)], "b": [(1, 1)]}
    # Restarts near the least height, so that earlier candidates decide, with repeats, losses and late numbers among them.
    for p in "cdef":
        out, epoch = [], 1
        for _ in range(5):
            top = rng.choice([900, 1003, 1040, 1090, 1200, 2500])
            for s in range(rng.randint(1, 99), top):
                if rng.random() < 0.97:
                    out.append((epoch, s))
                if rng.random() < 0.01:
                    out.append((epoch, rng.randint(1, 99) if rng.random() < 0.5 else max(1, s - rng.randint(0, 50))))
            if rng.random() < 0.2:
                epoch += 1
        sent[p] = out
    df = spark.createDataFrame([(p, e, s, i) for p, rows in sent.items() for i, (e, s) in enumerate(rows)], EVENT)
    got = {(r.publisher, r.arrival): r for r in sequence.verdicts(df, 700).collect()}
    restarts = 0
    for p, rows in sent.items():
        t, numbers = Tracker(), {}
        for i, (e, s) in enumerate(rows):
            v = t.observe(e, s)
            restarts += v == "after_restart"
            assert got[p, i].verdict == v, (p, i, e, s, v)
            if v != "stale_epoch":
                assert numbers.setdefault((e, got[p, i].incarnation), t.incarnation) == t.incarnation
    assert restarts > 10


def test_capped_intervals_equal_merging(spark):
    rng = random.Random(3)
    at, rows = 0, []
    for _ in range(60):
        lo = at + rng.randint(2, 9)
        at = lo + rng.randint(0, 4)
        rows.append(("p", 1, lo, at))
    df = spark.createDataFrame(rows, "publisher string, epoch long, lo long, hi long")
    got = sorted((r.lo, r.hi) for r in sequence.capped_gaps(df, 10).collect())
    assert len(got) == 10 and got[0][0] == rows[0][2] and got[-1][1] == rows[-1][3]
    holes = sorted((b[2] - a[3] for a, b in zip(rows, rows[1:])), reverse=True)[:9]
    assert sorted((b[0] - a[1] for a, b in zip(got, got[1:])), reverse=True) == holes
    assert len(sequence.merged([[r[2], r[3]] for r in rows], 10)) == 10
    # No task needs a publisher's intervals as a whole.
    for block, most in ((1, 10), (16, 10), (40, 60), (16, 100), (16, 1)):
        found = sequence.capped_gaps(df, most, block).collect()
        assert {r.truncated for r in found} == {most < 60}
        kept = sorted((r.lo, r.hi) for r in found)
        assert kept == got if most == 10 else len(kept) == min(most, 60)


def test_no_task_holds_a_whole_publisher(spark, tmp_path, monkeypatch):
    """One publisher in one epoch: its events are numbered and judged, and its gaps found, in several tasks."""
    monkeypatch.setattr(changes, "BLOCK", 100)
    for name, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        spark.range(7000, 8000).selectExpr("id as event_id", "timestamp_ntz'2026-01-01' as ts", "id % 7 as user_id", "'click' as event_type").write.parquet(f"{tmp_path}/events.parquet")
        rows = changes.change_stream(spark, str(tmp_path))
        judged = sequence.verdicts(rows.filter("seq % 10 <> 4"), 1000)
        spread = lambda df: {r[0] for r in df.select(F.spark_partition_id()).distinct().collect()}
        assert len(spread(rows)) > 1 and len(spread(judged)) > 1
        assert [(r.event_id, r.seq) for r in rows.orderBy("event_id").collect()] == [(7000 + i, i + 1) for i in range(1000)]
        assert {r.verdict: r["count"] for r in judged.groupBy("verdict").count().collect()} == {"first_seen": 1, "with_gap": 100, "accept": 799}
        found = sequence.gaps(sequence.current(judged), 100)
        assert len(spread(found)) > 1 and sorted((r.lo, r.hi) for r in found.collect()) == [(i, i) for i in range(4, 1000, 10)]
    finally:
        for name in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)


def test_set_fold_equals_a_loop(spark):
    rng = random.Random(8)
    rows = []
    for k in range(30):
        for i in range(40):
            op = rng.choice(["add", "add", "add", "remove", "set", "delete"])
            m = rng.choice("abcd") if op in ("add", "remove") else rng.choice(["a,b", ",,", "c,c,d", ""]) if op == "set" else None
            rows.append((f"k{k}", op, m, k * 100 + i))
    got = {r.key: r.members for r in projections.as_sets(projections.members(spark.createDataFrame(rows, "key string, op string, member string, arrival long"))).collect()}
    for k in range(30):
        held = set()
        for key, op, m, _ in rows:
            if key == f"k{k}":
                if op == "add":
                    held.add(m)
                elif op == "remove":
                    held.discard(m)
                else:
                    held = {x for x in (m or "").split(",") if x}
        assert got.get(f"k{k}", []) == sorted(held)


def test_counters_saturate(spark):
    top = (1 << 63) - 1
    rows = [("a", "incr", top, None, 1), ("a", "incr", top, None, 2), ("a", "incr", -5, None, 3), ("b", "set", None, "7", 1), ("b", "incr", 2, None, 2), ("b", "set", None, "junk", 3), ("c", "incr", 1, None, 1), ("c", "delete", None, None, 2)]
    df = spark.createDataFrame(rows, "key string, op string, delta long, value string, arrival long")
    assert {r.key: r.value for r in projections.counter(df).collect()} == {"a": top, "b": 9}
    assert {r.key: r.value for r in projections.exact_counter(df).collect()} == {"a": top - 5, "b": 9}


def test_order_does_not_matter_for_commutative_folds(spark):
    rng = random.Random(2)
    rows = [(f"k{i % 7}", "incr", rng.randint(-9, 9), i) for i in range(300)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    kind = "key string, op string, delta long, arrival long"
    a, b = (sorted(projections.increments(spark.createDataFrame(x, kind)).collect()) for x in (rows, shuffled))
    assert a == b


def test_no_op_changes_leave_versions(spark):
    kind = "key string, op string, value string, ttl long, seq long, epoch long, publisher string, observed_at timestamp_ntz, user_id long, arrival long"
    import datetime

    t = datetime.datetime(2024, 1, 1)
    ops = [("delete", None), ("set", "x"), ("set", "x"), ("delete", None), ("delete", None), ("set", "y")]
    df = spark.createDataFrame([("k", op, v, None, i, 1, "p", t + datetime.timedelta(seconds=i), 0, i) for i, (op, v) in enumerate(ops)], kind)
    row = state.expected(df).first()
    assert (row.version, row.value, row.last_change_at.second) == (4, "y", 5)


@pytest.mark.parametrize("glob, yes, no", [("a*c", "abbc", "ab/c"), ("a?c", "abc", "a/c"), ("[!x]y", "ay", "xy"), ("a.b", "a.b", "axb"), ("\\*", "*", "a")])
def test_globs(spark, glob, yes, no):
    row = spark.range(1).select(fn.matches_glob(fn.F.lit(yes), glob).alias("y"), fn.matches_glob(fn.F.lit(no), glob).alias("n")).first()
    assert (row.y, row.n) == (True, False)


def test_malformed_globs_match_nothing(spark):
    assert not fn.valid_glob("") and not fn.valid_glob("[ab")
    assert spark.range(1).select(fn.matches_glob(fn.F.lit("[ab"), "[ab").alias("x")).first().x is False


def test_key_templates():
    with pytest.raises(ValueError):
        fn.key_template("{{.Nothing}}", {})


def test_every_pattern_of_a_long_table_is_tried(spark):
    rows = spark.createDataFrame([(f"p{i}:x", "complete", i) for i in range(1100)] + [("q:x", "complete", -1), (None, "complete", -1)], "key string, trust string, n int")
    got = trust.mark_patterns(rows, spark.createDataFrame([(f"^p{i}:",) for i in range(1100)], "regex string"))
    assert got.columns == rows.columns and got.count() == 1102
    assert [r.n for r in got.filter("trust = 'complete'").collect()] == [-1, -1]


def test_large_sets_are_cut_as_small_ones(spark, monkeypatch):
    rows = [("big", f"m{i:05d}") for i in range(3000)] + [("small", m) for m in "cab"]
    df = spark.createDataFrame(rows, "key string, member string").repartition(3)
    whole = {r.key: r for r in projections.as_sets(df).collect()}
    cut = {r.key: r for r in projections.as_sets(df, 100).collect()}
    assert (whole["big"].members, whole["big"].size, whole["big"].truncated) == (sorted(m for _, m in rows[:3000]), 3000, False)
    assert (cut["big"].members, cut["big"].size, cut["big"].truncated) == (sorted(m for _, m in rows[:3000])[:100], 3000, True)
    assert (cut["small"].members, cut["small"].size, cut["small"].truncated) == (["a", "b", "c"], 3, False)
    assert projections.as_sets(df.limit(0)).count() == 0


def test_totals_across_blocks_and_nulls(spark):
    from tidemark.operators import metrics

    block = sequence.BLOCK
    rows = [("k", 1, 5), ("k", 2, 9), ("k", block, 12), ("k", 2 * block + 1, 3), ("k", 2 * block + 2, None), ("k", 2 * block + 3, 8), ("j", 7, 1), (None, 1, 4), (None, 2, 6)]
    got = {(r.key, r.at): r.delta for r in metrics.deltas(spark.createDataFrame(rows, "key string, at long, total long"), ["key"], "at", "total").collect()}
    assert got == {("k", 1): 0, ("k", 2): 4, ("k", block): 3, ("k", 2 * block + 1): 0, ("k", 2 * block + 2): 0, ("k", 2 * block + 3): 0, ("j", 7): 0, (None, 1): 0, (None, 2): 2}


def test_findings_are_ranked_across_ranges(spark):
    from tidemark.operators import reconcile

    rng = random.Random(3)
    rows = [(f"k{i:04d}", c, i) for c in ("value_mismatch", "missing_in_target", "ttl_mismatch") for i in rng.sample(range(2000), 700)]
    df = spark.createDataFrame(rows, "key string, category string, n long")
    for found in (df, df.limit(0)):
        got = {(r.category, r.place): (r.key, r.n, r.ordinal) for r in reconcile.ranked(found.repartition(5)).collect()}
        want = {}
        for c in reconcile.CATEGORIES if found is df else ():
            for place, (k, _, n) in enumerate(sorted(r for r in rows if r[1] == c), 1):
                want[c, place] = (k, n, reconcile.CATEGORIES.index(c) + 1)
        assert got == want
