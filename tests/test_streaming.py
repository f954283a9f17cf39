import json

import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import main
from tidemark.plans import config
from tidemark.sources import files
from tidemark.streaming import ordering
from tidemark.streaming.audit import Audit, Lifecycle
from tidemark.operators.sequence import Tracker

KIND = "publisher string, epoch long, seq long, arrival long"


def write_batches(spark, rows, kind, folder, n):
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], kind).coalesce(1).write.mode("append").parquet(folder)


def test_tracker_over_micro_batches(spark, tmp_path):
    rows = [("a", 1, s, i) for i, s in enumerate([1, 2, 5, 3, 3, 9, 4, 4])] + [("b", 2, 7, 8), ("b", 1, 1, 9), ("b", 3, 1, 10)]
    write_batches(spark, rows, KIND, f"{tmp_path}/in", 3)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ordering.verdict_stream(stream).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.publisher, r.arrival): r.verdict for r in spark.table("verdicts").collect()}
    for p in "ab":
        t = Tracker()
        for _, e, s, i in (r for r in rows if r[0] == p):
            assert got[p, i] == t.observe(e, s)


def test_reorder_buffer():
    b = ordering.Buffer()
    out = [b.offer(1, s, i) for i, s in enumerate([1, 3, 4, 2, 2, 7])]
    assert [[x[1] for x in o] for o in out] == [[1], [], [], [2, 3, 4], [2], []]
    assert [x[1] for x in b.offer(2, 1, 9)] == [7, 1]
    for s in range(3, ordering.HELD + 3):
        assert b.offer(2, s, s) == []
    assert len(b.offer(2, ordering.HELD + 5, 0)) == ordering.HELD + 1


def test_batches_fold_to_the_same_state(spark, tmp_path):
    kind = "key string, op string, value string, ttl long, arrival long"
    rows = [(f"k{i % 7}", "delete" if i % 5 == 0 else "set", None if i % 5 == 0 else f"v{i}", None, i) for i in range(60)]
    write_batches(spark, rows, kind, f"{tmp_path}/in", 4)
    seen = []
    a = Audit(spark, f"{tmp_path}/audit")
    assert a.state() is None
    a.subscribe(lambda df, n: seen.append((n, df.count())))
    a.start(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", once=True).awaitTermination()
    from tidemark.operators.projections import scalar

    whole = {(r.key, r.op, r.value) for r in scalar(spark.createDataFrame(rows, kind)).collect()}
    assert {(r.key, r.op, r.value) for r in a.state().collect()} == whole and len(seen) == 4
    a.batch(spark.createDataFrame(rows[-15:], kind), 3)  # the last batch once more
    assert {(r.key, r.op, r.value) for r in a.state().collect()} == whole


def test_phases():
    x = Lifecycle("Strict")
    assert x.phase == "Pending"
    x.started = True
    assert x.phase == "AwaitingSnapshot"
    x.snapshot_end()
    assert x.phase == "Watching"
    x.connected = False
    assert x.phase == "Degraded"
    x.paused = True
    assert x.phase == "Paused"


def test_specification_names_all_problems():
    with pytest.raises(ValueError) as e:
        config.load("source: {type: zmq}\npolicy: {safety: 0.5, sweep: 10ms, nonsense: 1}\n")
    assert all(x in str(e.value) for x in ("source.type", "safety", "sweep", "nonsense"))
    spec = config.load("source: {type: file}\npolicy: {sweep: 8s, window: 5}\n")
    assert (spec.policy.sweep_us, spec.policy.window_us) == (8_000_000, 5_000_000) and spec.warnings()
    other = config.load("source: {type: file}\nprojection: {type: set}\n")
    assert config.update_problems(spec, other) == ["projection.type can not change"]
    assert [config.duration(x) for x in (1.5, "1h30m", "-2ms", "7")] == [1_500_000, 5_400_000_000, -2000, 7_000_000]


def test_command_line(spark, tmp_path, capsys):
    events = [{"publisher": "p", "seq": i + 1, "op": "set", "key": f"k{i}", "value": f"v{i}", "ts": 1700000000 + i} for i in range(6)]
    (tmp_path / "events.jsonl").write_text("\n".join(map(json.dumps, events)) + "\n\n")
    (tmp_path / "same.json").write_text(json.dumps({"scalars": {e["key"]: e["value"] for e in events}}))
    (tmp_path / "other.json").write_text(json.dumps({"scalars": {"k0": "x", "k1": "v1"}}))
    (tmp_path / "spec.yaml").write_text("source: {type: file}\n")
    at = ["--spec", f"{tmp_path}/spec.yaml", "--events", f"{tmp_path}/events.jsonl", "--store"]
    assert main(["diff", *at, f"{tmp_path}/same.json"]) == 0
    assert main(["replay", *at, f"{tmp_path}/other.json", "--output", "json"]) == 3
    assert len(json.loads(capsys.readouterr().out.strip().splitlines()[-1])) == 5
    assert main(["explain", *at, f"{tmp_path}/other.json", "k0"]) == 0
    assert "value_mismatch" in capsys.readouterr().out
    (tmp_path / "spec.yaml").write_text("source: {type: nothing}\n")
    assert main(["diff", *at, f"{tmp_path}/same.json"]) == 2
    assert main(["version"]) == 0


def _compare(spark, at, shape, events, store):
    import json

    from tidemark.plans import config, run

    (at / "events.jsonl").write_text("\n".join(json.dumps({"publisher": "p", "epoch": 1, "ts": "2026-01-01T00:00:00Z"} | e) for e in events))
    (at / "store.json").write_text(json.dumps(store))
    return run.compare(spark, config.Spec(source={"type": "file"}, projection={"type": shape}), str(at / "events.jsonl"), str(at / "store.json"))


def test_sets_and_counters_are_compared(spark, tmp_path):
    ops = [("a", "add", "x"), ("a", "add", "y"), ("a", "remove", "x"), ("b", "add", "z"), ("c", "add", "z"), ("d", "add", "z"), ("d", "remove", "z")]
    events = [{"seq": i, "op": op, "key": k, "member": m} for i, (k, op, m) in enumerate(ops, 1)]
    got = _compare(spark, tmp_path, "set", events, {"sets": {"a": ["y"], "b": ["z", "w"]}, "scalars": {"c": "z"}})
    assert {(r.key, r.category) for r in got.findings.collect()} == {("b", "member_mismatch"), ("c", "type_mismatch")}
    events = [{"seq": i, "op": "incr", "key": k, "delta": n} for i, (k, n) in enumerate([("a", 2), ("a", 3), ("b", 1), ("c", 1)], 1)]
    got = _compare(spark, tmp_path, "counter", events, {"scalars": {"a": "5", "b": "7"}})
    assert {(r.key, r.category) for r in got.findings.collect()} == {("b", "counter_mismatch"), ("c", "missing_in_target")}


def test_changes_after_a_restart_within_an_epoch_are_applied(spark, tmp_path):
    # A minute apart, so that no number waits for another.
    events = [{"seq": s, "op": "set", "key": "k", "value": f"{s}", "ts": f"2026-01-01T00:{i:02d}:00Z"} for i, s in enumerate((1, 2, 2000, 1, 2, 3))]
    got = _compare(spark, tmp_path, "scalar", events, {"scalars": {"k": "3"}})
    assert got.findings.count() == 0
    row = got.publishers.first()
    assert (row.restarts, row.high, row.missing) == (1, 3, 0)


def test_watch_confirms_what_a_second_look_still_finds(spark, tmp_path):
    from tidemark.streaming.watch import Watch

    spec = config.load("source: {type: file_stream}\npolicy: {window: 5, sweep: 8s, bootstrap: Wait, extras: 50s}\n")
    event = lambda p, s, k, v, **x: json.dumps({"publisher": p, "epoch": 1, "seq": s, "op": "set", "key": k, "value": v, "ts": "2026-01-01T00:00:00Z"} | x)
    (tmp_path / "in").mkdir()
    (tmp_path / "store.json").write_text(json.dumps({"scalars": {"a": "1", "b": "old", "x": "left over"}}))
    w = Watch(spark, str(tmp_path / "audit"), spec, str(tmp_path / "store.json"))

    def step(number, minute, lines):
        (tmp_path / f"f{number}").write_text("\n".join(lines))
        w.now = F.expr(f"timestamp_ntz'2026-01-01 00:{minute:02d}:00'")
        w.batch(files.lines(spark, str(tmp_path / f"f{number}")), number)
        return w.status()[-1]

    one = step(0, 1, [event("p", 1, "a", "1"), event("p", 2, "b", "2"), event("p", 3, "c", "3"), "{broken", event("p", 4, "d", "4", op="frob")])
    # The key that nothing is known of is parked, apart from the queue.
    assert (one["applied"], one["decode_errors"], one["divergent"], one["queue"], one["episodes"], one["extras_parked"], one["extras"]) == (3, 2, 2, 2, 0, 1, 0)
    # b is caught up with, c and x stay wrong; a publisher that lost numbers 4 to 8.
    (tmp_path / "store.json").write_text(json.dumps({"scalars": {"a": "1", "b": "2", "x": "left over"}}))
    two = step(1, 2, [event("p", 9, "a", "1"), event("p", 9, "a", "1")])
    # c rests on a stream with a gap, so it is not confirmed; x was there at both looks.
    assert (two["missing"], two["confirmed"], two["received"], two["applied"], two["extras"]) == (5, 0, 2, 1, 1)
    again = step(1, 2, [event("p", 9, "a", "1"), event("p", 9, "a", "1")])  # the batch once more
    assert again == two
    assert {(r.key, r.category, r.trust) for r in w.findings().collect()} == {("c", "missing_in_target", "suspect"), ("x", "extra_in_target", "complete")}
    three = step(2, 3, [event("p", 1, "c", "3", epoch=2), event("p", 2, "c", "4", epoch=2)])
    assert (three["restarts"], three["missing"], three["episodes"], three["divergent"]) == (1, 0, 0, 1)
    (tmp_path / "store.json").write_text(json.dumps({"scalars": {"a": "1", "b": "2", "c": "4"}}))
    four = step(3, 4, [event("p", 3, "e", "", epoch=2, op="delete")])
    assert (four["divergent"], four["episodes"], four["queue"], four["extras"]) == (0, 0, 0, 0)
    # Trackers, state and the rest of the last batches are kept, not of all.
    assert len(list((tmp_path / "audit" / "entries").iterdir())) <= 3 and len(w.status()) == 4


def test_watch_on_the_command_line_takes_sets_and_ends(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    events = [{"publisher": "p", "epoch": 1, "seq": i + 1, "op": op, "key": k, "member": m, "ts": "2026-01-01T00:00:00Z"} for i, (k, op, m) in enumerate([("a", "add", "x"), ("a", "add", "y"), ("b", "add", "z")])]
    for i, e in enumerate(events):
        (tmp_path / "in" / f"{i}.jsonl").write_text(json.dumps(e))
    (tmp_path / "store.jsonl").write_text("\n".join(json.dumps(x) for x in ({"key": "a", "stored_type": "set", "members": ["y", "x"]}, {"key": "b", "stored_type": "set", "members": ["z", "w"]})))
    (tmp_path / "spec.yaml").write_text("source: {type: file_stream}\nprojection: {type: set}\npolicy: {bootstrap: Wait}\n")
    at = ["--spec", f"{tmp_path}/spec.yaml", "--events", f"{tmp_path}/in", "--folder", f"{tmp_path}/audit", "--store", f"{tmp_path}/store.jsonl", "--once"]
    before = (tmp_path / "store.jsonl").read_bytes()
    assert main(["watch", *at]) == 3
    assert "member_mismatch" in capsys.readouterr().out
    assert (tmp_path / "store.jsonl").read_bytes() == before and sorted(x.name for x in tmp_path.iterdir()) == ["audit", "in", "spec.yaml", "store.jsonl"]


def test_extras_explanations_and_widths(spark, tmp_path, capsys):
    from tidemark.plans import run

    events = [{"seq": i + 1, "op": "set", "key": k, "value": v} for i, (k, v) in enumerate([("a", "1"), ("b", "2"), ("k" * 200, "w" * 300)])]
    got = _compare(spark, tmp_path, "scalar", events, {"scalars": {"a": "1", "x": "9"}, "sets": {"b": ["m"]}})
    assert {(r.key[:1], r.category) for r in got.findings.collect()} == {("x", "extra_in_target"), ("b", "type_mismatch"), ("k", "missing_in_target")}
    code = lambda key: {d["code"] for d in run.explanation(got, key)["diagnoses"]}
    assert (run.explanation(got, "a")["verdict"], code("a")) == ("agrees", {"AGREE"})
    assert code("x") == {"EXTRA_IN_TARGET", "NO_HISTORY"} and code("b") == {"TYPE_MISMATCH"} and code("k" * 200) == {"MISSING_IN_TARGET_NO_GAPS"}
    assert run.explanation(got, "nowhere")["verdict"] == "unknown"
    assert all(len(x) <= 100 for x in run.explain_key(got, "k" * 200).splitlines())
    members = _compare(spark, tmp_path, "set", [{"seq": 1, "op": "add", "key": "s", "member": "m"}, {"seq": 2, "op": "add", "key": "s", "member": "n"}], {"sets": {"s": ["m"]}})
    assert "MEMBER_SUBSET" in {d["code"] for d in run.explanation(members, "s")["diagnoses"]}


def test_text_helpers():
    from tidemark.functions import text

    assert [text.clip("abcdef", n) for n in (6, 4, 1, 0)] == ["abcdef", "abc…", "…", ""]
    assert text.clip_middle("abcdefgh", 5) == "ab…gh" and text.clip_middle("ab", 5) == "ab"
    assert text.wrap("one two three", 8, "  ") == ["one two", "  three"] and text.wrap("") == [""]
    assert [text.plural(n, "key") for n in (0, 1, 2)] == ["0 keys", "1 key", "2 keys"] and text.plural(2, "entry", "entries") == "2 entries"


def test_stores_by_name_are_only_read(spark, tmp_path):
    from tidemark.sources import stores

    rows = {("a", "string", "1", None), ("s", "set", None, ("m", "n"))}
    (tmp_path / "x.json").write_text(json.dumps({"scalars": {"a": "1"}, "sets": {"s": ["m", "n"]}}))
    (tmp_path / "x.jsonl").write_text('{"key": "a", "stored_type": "string", "scalar": "1"}\n{"key": "s", "stored_type": "set", "members": ["m", "n"]}')
    stores.reader("memory")(spark, {"a": "1"}, {"s": ["m", "n"]}).write.parquet(f"{tmp_path}/x")
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*")}
    for at in ("x.json", "x.jsonl", "x"):
        assert {(r.key, r.stored_type, r.scalar, r.members and tuple(r.members)) for r in stores.reader("file")(spark, f"{tmp_path}/{at}").collect()} == rows
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*")} == before
    with pytest.raises(ValueError):
        stores.reader("redis")
    with pytest.raises(ValueError):
        stores.register("file")(print)


def test_numbers_at_the_end_of_the_range(spark, tmp_path):
    top = (1 << 63) - 1
    events = [{"seq": s, "op": "set", "key": f"k{i}", "value": "v"} for i, s in enumerate((top - 1, top, top + 1, (1 << 64) - 1))]
    got = _compare(spark, tmp_path, "scalar", events, {"scalars": {"k0": "v", "k1": "v"}})
    assert {r.verdict for r in got.judged.collect()} == {"first_seen", "accept"} and got.findings.count() == 0
    assert {(r.reason, r.n) for r in got.drops.collect()} == {("validation_error", 2)}
