"""One comparison from files: events and a store snapshot in, findings and a report out."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codecs, text
from tidemark.functions.columns import key_template, pressure_percent
from tidemark.operators import explain, order, reconcile, sequence, state, trust, validate
from tidemark.plans.config import KEY_FIELDS, Spec
from tidemark.sources import files, stores
from tidemark.tables import stored


@dataclass
class Result:
    state: DataFrame
    findings: DataFrame
    drops: DataFrame
    publishers: DataFrame
    judged: DataFrame
    store: DataFrame
    shape: str
    spec: Spec
    health: dict

    @property
    def alertable(self) -> int:
        return self.findings.filter("trust <> 'suspect'").count()

    def text(self) -> str:
        """The report as lines: counts by category, then the findings, at most so many."""
        rows = reconcile.report(self.findings).orderBy("category").collect()
        lines = [f"{r.category:<20}{r.n:>8}  suspect {r.suspect}" for r in rows] or ["no disagreement"]
        lines += [f"  {r.category} {r.key}: expected {r.expected}, stored {r.stored} ({r.trust}, version {r.version})" for r in reconcile.capped(self.findings, min(100, self.spec.policy.max_findings)).collect()]
        return "\n".join(lines)

    def json(self) -> str:
        return json.dumps([r.asDict() for r in reconcile.capped(self.findings, self.spec.policy.max_findings).select("key", "category", "trust", "expected", "stored", "version").collect()], default=str)


def decode(raw: DataFrame, spec: Spec) -> DataFrame:
    c, most = spec.codec, spec.policy.max_payload
    long = F.octet_length("payload") > most
    raw = raw.withColumns({"__long": long, "payload": F.when(~long, F.col("payload"))})
    if c["type"] == "template":
        rows = codecs.decode_template(raw, c["pattern"], c.get("ops"))
    elif c["type"] == "msgpack":
        rows = codecs.decode_msgpack(raw, c.get("fields"), c.get("ops"))
    else:
        rows = codecs.decode_json(raw, c.get("fields"), c.get("ops"))
    return rows.withColumn("err", F.when(F.col("__long"), "too_large").otherwise(F.col("err"))).drop("__long")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return stores.reader("file")(spark, path)


def prepared(rows: DataFrame, spec: Spec | None = None) -> DataFrame:
    """Decoded rows with the types and the problem column that the audit works on, and keys as the store has them. Epochs and numbers of 2^63 or more are refused."""
    rows = rows.withColumns({
        "__over": F.expr("epoch > 9223372036854775807 or seq > 9223372036854775807"), "epoch": F.col("epoch").try_cast("long"), "seq": F.col("seq").try_cast("long"),
        "published_at": F.col("published_at").cast("timestamp_ntz"), "observed_at": F.coalesce("published_at", F.timestamp_seconds(F.lit(0))).cast("timestamp_ntz"), "user_id": F.lit(None).cast("long"),
    })
    problem = F.coalesce(F.when(F.col("__over"), "invalid:seq"), validate.problem(*[F.col(c) for c in ("op", "publisher", "member", "value", "delta", "ttl")]))
    rows = rows.withColumn("problem", F.when(F.col("err").isNull(), problem)).drop("__over")
    if spec and spec.projection.get("key"):
        rows = rows.withColumn("key", key_template(spec.projection["key"], {n: F.coalesce(F.col(c), F.lit("")) for n, c in KEY_FIELDS.items()}))
    return rows


def expectation(applied: DataFrame, shape: str) -> DataFrame:
    """What a store should hold, with the stamp of each key's last write."""
    return state.expected(applied, carry=["stamp"]) if shape == "scalar" else state.expected_fold(applied, shape, carry=["stamp"])


def disagreements(known: DataFrame, kept: DataFrame, shape: str, forgiven: Column | None = None, at: Column | None = None, tolerance_us: int | None = None) -> DataFrame:
    """Findings of both directions: settled keys that are stored otherwise, and stored keys that nothing is known of."""
    found = reconcile.sweep(known, kept, shape, forgiven, at, tolerance_us)
    read = reconcile.typed(kept, shape).filter("kind <> 'absent'").select("key", reconcile.shown(shape).alias("stored"))
    extra = reconcile.extras(read, known).select("key", F.lit("extra_in_target").alias("category"), F.lit("complete").alias("trust"), F.lit(None).cast("string").alias("expected"), "stored", F.lit(0).cast("long").alias("version"), F.lit(None).cast("long").alias("user_id"))
    return found.unionByName(extra)


def judged_in_order(good: DataFrame, spec: Spec) -> DataFrame:
    """Valid events put back in order, with verdict, incarnation and stamp; arrival is the order they are judged in."""
    rows = good if spec.commutative else stored(order.reordered(good, spec.policy.reorder_us), "ordered")
    judged = stored(sequence.capped(stored(sequence.verdicts(rows), "verdicts")), "capped")
    stamps = trust.stamps(judged).select("arrival", "stamp")
    # Stale epochs are not stamped; nothing is written by them.
    return judged.join(stamps, "arrival", "left").withColumn("stamp", F.coalesce("stamp", F.lit("complete")))


def compare(spark: SparkSession, spec: Spec, events: str, store: str, now: str | None = None) -> Result:
    """events: a file of lines; store: see read_store(); now: when the store was read, an SQL expression. By default that is now, and late enough for all events to have settled.

    A snapshot does not change, so one look is as good as two. Nothing is adopted: the events are all there is.
    """
    p = spec.policy
    raw = files.lines(spark, events).drop("observed_at")
    # A file's lines come in order; numbers grow along a partition and from one to the next.
    rows = stored(prepared(decode(raw.withColumn("arrival", F.monotonically_increasing_id()), spec), spec), "events")
    judged = stored(judged_in_order(rows.filter("err is null and problem is null"), spec), "judged")
    shape = spec.projection.get("type", "scalar")
    applied = judged.filter(sequence.accepted(F.col("verdict"))).filter(validate.touches_key(F.col("op")))
    last = rows.agg(F.max("observed_at").alias("t")).first().t
    at = F.expr(now).cast("timestamp_ntz") if now else F.greatest(F.current_timestamp().cast("timestamp_ntz"), state.plus(F.lit(last).cast("timestamp_ntz"), p.max_window_us + 1_000_000))
    at = F.lit(spark.range(1).select(at.alias("t")).first().t)
    known = state.settled(state.expired(expectation(applied, shape), at), at, p.window_us, p.max_window_us, p.never_settled)
    if shape == "set":
        known = known.withColumn("is_settled", F.col("is_settled") & (F.coalesce(F.json_array_length("value"), F.lit(0)) <= p.max_members))
    ends = trust.clears(judged.filter(sequence.accepted(F.col("verdict"))), spec.ownership)
    found = trust.latest(trust.marks(judged, spec.ownership, errors=rows.filter("err is not null")), ends)
    if p.bootstrap == "Strict" and ends.isEmpty():
        known = known.withColumn("stamp", F.lit("suspect"))
    known = stored(trust.effective(known, found, spec.ownership), "known")
    kept = stored(read_store(spark, store), "store")
    dropped = rows.join(judged.select(F.col("received").alias("arrival") if "received" in judged.columns else F.col("arrival"), "verdict"), "arrival", "left").withColumn("reason", validate.drop_reason(F.col("err"), F.col("problem"), F.col("verdict")))
    drops = dropped.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    forgiven = reconcile.suppressed(p.expiry, F.col("last_event_at"), at, p.assumed_ttl_us)
    return Result(known, disagreements(known, kept, shape, forgiven, at, spec.tolerance_us), drops, sequence.publishers(judged), judged, kept, shape, spec, read_health(spark, spec))


def read_health(spark: SparkSession, spec: Spec) -> dict:
    """pressure (percent) and evicted of the store, from the INFO text that target.health names; nothing is known without one."""
    at = spec.target.get("health")
    if not at:
        return {"pressure": 0, "evicted": 0}
    found = reconcile.health(spark.read.text(at, wholetext=True).select(F.lit(0).alias("id"), F.col("value").alias("info")))
    r = found.select(F.coalesce(pressure_percent(F.col("used_memory"), F.col("max_memory")), F.lit(0)).alias("pressure"), F.coalesce("evicted_keys", F.lit(0)).alias("evicted")).first()
    return r.asDict()


def explanation(result: Result, key: str) -> dict:
    """All that is known about one key, as a document: verdict, values, publisher, history, diagnoses."""
    own = F.col("key") == key
    row, kept = result.state.filter(own).first(), reconcile.typed(result.store.filter(own), result.shape).withColumn("shown", reconcile.shown(result.shape)).first()
    events = result.judged.filter(own & sequence.accepted(F.col("verdict"))).select("arrival", "op", "value", "member", "delta", "observed_at", "epoch")
    n = events.count()
    steps = list(reversed(events.orderBy(F.desc("arrival")).limit(result.spec.policy.ring).collect()))
    found = result.findings.filter(own).first()
    pub = result.publishers.filter(F.col("publisher") == row.last_publisher).first() if row else None
    readable, value = kept is None or kept.kind != "wrong_type", kept.shown if kept else None
    here, gone = kept is not None and kept.kind != "absent", row is None or row.kind == "absent"
    difference = [0, 0]
    if result.shape == "set" and row and value:
        mine, other = set(json.loads(row.value or "[]")), set(json.loads(value))
        difference = [len(mine - other), len(other - mine)]
    fact = {
        "key": key, "known": row is not None, "stored": here, "readable": readable, "settled": bool(row.is_settled) if row else True, "trust": row.trust if row else "complete",
        "kind": row.kind if row else "absent", "equal": readable and gone == (not here) and (gone or row.value == value), "publisher_missing": pub.missing if pub else 0,
        "restarted": bool(pub and pub.restarts), "skew_us": 0, "history": n, "reachable": True, **result.health, "expired": bool(row.is_expired) if row else False, "window_us": result.spec.policy.window_us,
        "ring": result.spec.policy.ring,
    }
    frame = result.state.sparkSession.createDataFrame([tuple(fact.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}" for k, v in fact.items()))
    codes = [(r.code, r.confidence) for r in explain.diagnoses(frame).orderBy("place").collect()]
    if all(x == 0 for x in difference) is False and 0 in difference:
        codes.append(("MEMBER_SUBSET" if difference[1] == 0 else "MEMBER_SUPERSET", "medium"))
    before = None
    history = []
    for r in steps:
        since = None if before is None else int((r.observed_at - before).total_seconds() * 1_000_000)
        history.append({"op": r.op, "value": r.value, "member": r.member, "delta": r.delta, "at": str(r.observed_at), "since_us": since})
        before = r.observed_at
    return {
        "key": key, "verdict": frame.select(explain.verdict({c: F.col(c) for c in frame.columns}).alias("v")).first().v, "category": found.category if found else None, "expected": row.value if row else None, "stored": value, "trust": fact["trust"],
        "version": row.version if row else 0, "publisher": row.last_publisher if row else None, "epoch": row.last_epoch if row else None, "seq": row.last_seq if row else None, "missing": fact["publisher_missing"],
        "history": history, "changes": n, "diagnoses": [{"code": c, "confidence": l, "says": explain.SAYS[c]} for c, l in codes],
    }


def explain_key(result: Result, key: str, width: int = text.WIDTH) -> str:
    """explanation() as lines of at most so many characters."""
    x = explanation(result, key)
    lines = [text.clip_middle(f"{key}: {x['verdict']}" + (f" ({x['category']})" if x["category"] else ""), width)]
    if x["version"]:
        lines += text.wrap(f"  expected {x['expected']}, version {x['version']}, {x['trust']}", width, "    ")
    lines += text.wrap(f"  stored {x['stored']}", width, "    ")
    if x["publisher"]:
        lines += text.wrap(f"  last written by {x['publisher']} ({x['epoch']}/{x['seq']}), which misses {text.plural(x['missing'], 'number')}", width, "    ")
    for d in x["diagnoses"]:
        lines += text.wrap(f"  {d['code']} ({d['confidence']}): {d['says']}", width, "    ")
    if x["history"]:
        lines.append(f"  the last {len(x['history'])} of {text.plural(x['changes'], 'change')}:")
        for h in x["history"]:
            what = next((str(h[c]) for c in ("value", "member", "delta") if h[c] is not None), "")
            lines.append(text.clip(f"    {h['at']} {h['op']} {what}".rstrip(), width))
    return "\n".join(lines)
