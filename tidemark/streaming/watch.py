"""The continuous audit: each micro-batch is put in order, judged, folded into the expected state, and compared with the store.

Everything that lasts is a table of the folder, one partition for each batch, written over if a batch runs again. A batch
reads the tables of the batch before it and of no other, and all but the last KEEP of them go, so its cost follows the
changes and the keys, not the number of batches. Tables: publishers (trackers), held (events that wait for a number), entries and
members (expected state), trust (the last mark and clearing of each scope), queue and episodes (disagreements that wait for a second look,
and confirmed ones), parked and extras (stored keys that nothing is known of, on a clock of their own), probes and lags (how
long the store takes to follow), findings. Only status, one row for each batch, is kept whole.

Events of a batch meet their publisher's tracker in one group: bounded by the batch, and trackers by the policy's number of
publishers and the largest number of intervals of each.
"""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import confirm, lag, ledger, metrics, order, reconcile, sequence, state, trust, validate
from tidemark.operators.sequence import Tracker
from tidemark.plans import run
from tidemark.plans.config import Spec
from tidemark.shipping import ship
from tidemark.streaming.audit import Lifecycle
from tidemark.tables import scratch, stored, together

#: Batches whose tables stay: the last one, and some for a look back.
KEEP = 3
#: An arrival is a number of the batch, a bit for events that were not held before, a partition and a row: so many bits each.
PART_BITS, ROW_BITS = 13, 26
EVENT = "publisher string, epoch long, seq long, op string, key string, member string, value string, ttl long, delta long, published_at timestamp_ntz, observed_at timestamp_ntz, user_id long, arrival long"
NAMES = [x.split()[0] for x in EVENT.split(", ")]
TRACKERS = "publisher string, tracker string"
TRACKER = "epoch long, high long, gaps array<array<long>>, truncated boolean, restarts long, incarnation long, last_seen long, events long, skew_us long, next long, wait_epoch long, oldest long"
TRUST = "pattern string, marked long, cleared long"
QUEUE = "key string, version long, category string, first_seen timestamp_ntz"
FINDINGS = "key string, category string, trust string, expected string, stored string, version long, user_id long, first_seen timestamp_ntz"
PARKED, PROBES, LAGS = "key string, parked_at timestamp_ntz", "key string, version long, event_at timestamp_ntz", "id long, at timestamp_ntz, lag_us long"
#: Fields of a status row.
COUNTS = """batch received applied decode_errors validation_errors duplicates stale late gap_events gap_signals source_signals publishers missing restarts truncated_gaps held held_released skew_us
keys settled in_flight never_settled tombstones adopted adopt_skipped expired evicted multi_writers projection_errors snapshots compared stored divergent suspect divergent_kept queue queue_dropped
confirmed transient episodes opened resolved extras extras_parked extras_total extras_resolved extra_scans lag_n lag_p50 lag_p99 probe_timeouts window_us window_changes sweeps sweeps_skipped""".split()
STATUS = ", ".join(f"{c} long" for c in COUNTS) + ", coverage double, phase string, awaiting boolean, paused boolean, reachable boolean, adaptive boolean, at timestamp_ntz, window_moved_at timestamp_ntz, extras_at timestamp_ntz"


def restored(text: str | None) -> tuple[Tracker, dict]:
    """A tracker and what else is known of its publisher."""
    t, more = Tracker(), {}
    if text:
        x = json.loads(text)
        more = {k: x.pop(k, None) for k in ("last_seen", "events", "skew_us", "next", "wait_epoch", "oldest")}
        t.__dict__.update(x)
    return t, more


def judge(rows: DataFrame, trackers: DataFrame, now_us: int, window_us: int) -> DataFrame:
    """Events with role, verdict, stamp and a new arrival, once they are in order or have waited for long enough.

    rows: events, with fresh = false for those that a batch before held. Roles: event; held, for those that go on waiting; and
    tracker, one more row for each publisher with nothing but what is known of it now.
    """
    ship(rows.sparkSession)
    names = rows.columns
    # As text through pandas, which has no nulls among whole numbers.
    as_text = [f.name for f in rows.schema if f.dataType.typeName() not in ("string", "boolean") and f.name not in ("epoch", "seq", "arrival")]
    kinds = {f.name: f.dataType for f in rows.schema}
    sent = rows.withColumns({"__at": F.unix_micros(F.col("observed_at").cast("timestamp")), "__skew": F.expr("timestampdiff(MICROSECOND, observed_at, published_at)")}).withColumns({c: F.col(c).cast("string") for c in as_text})
    shown = ", ".join(f"`{c}` {'string' if c in as_text else kinds[c].simpleString()}" for c in names) + ", role string, verdict string, stamp string, tracker string"

    def work(key: tuple, own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        t, more = restored(before.tracker.iloc[0] if len(before) else None)
        own = own.sort_values(["fresh", "arrival"], kind="stable")
        b = order.Holdback(window_us)
        b.epoch, b.next, b.oldest = more.get("wait_epoch"), more.get("next"), more.get("oldest")
        came, epochs, seqs, ops = (own[c].tolist() for c in ("arrival", "epoch", "seq", "op"))
        found, verdicts, stamps = [], [], []

        def give(items: list[int]) -> None:
            found.extend(items)
            for i in items:
                verdicts.append(t.observe(epochs[i], seqs[i]))
                if ops[i] == "snapshot_end" and verdicts[-1] in sequence.ACCEPTED:
                    t.gaps, t.truncated = [], False
                stamps.append("suspect" if t.gaps else "complete")

        for i, (fresh, at) in enumerate(zip(own.fresh.tolist(), own["__at"].tolist())):
            if fresh:
                give(b.offer(epochs[i], seqs[i], at, i))
            else:
                b.held.setdefault(seqs[i], []).append(i)
        give(b.expire(now_us))
        waiting = [i for items in b.held.values() for i in items]
        places = sorted(came)[: len(found)]  # events take each other's places, in the order they are released
        fresh = own[own.fresh]
        if len(fresh):
            more["last_seen"], more["events"] = max(int(fresh["__at"].max()), more.get("last_seen") or 0), (more.get("events") or 0) + len(fresh)
            skews = fresh["__skew"].dropna()
            more["skew_us"] = int(skews.iloc[-1]) if len(skews) else more.get("skew_us")
        more |= {"next": b.next, "wait_epoch": b.epoch, "oldest": b.oldest}
        parts = [own.iloc[found][names].assign(arrival=places, role="event", verdict=verdicts, stamp=stamps, tracker=None), own.iloc[waiting][names].assign(role="held", verdict=None, stamp=None, tracker=None)]
        last = {**dict.fromkeys(names), "publisher": key[0], "role": "tracker", "verdict": None, "stamp": None, "tracker": json.dumps(t.__dict__ | more)}
        return pd.concat([p.astype(object) for p in [*parts, pd.DataFrame([last])] if len(p)])[[*names, "role", "verdict", "stamp", "tracker"]]

    done = sent.groupBy("publisher").cogroup(trackers.groupBy("publisher")).applyInPandas(work, shown)
    return done.withColumns({c: F.col(c).cast(kinds[c]) for c in as_text})


class Watch:
    def __init__(self, spark: SparkSession, folder: str, spec: Spec, store: str | None = None, now: str | None = None) -> None:
        """now: an SQL expression for the time of a sweep, for drills; otherwise the session's clock."""
        self.spark, self.folder, self.spec, self.store = spark, folder.rstrip("/"), spec, store
        self.now = F.expr(now or "cast(current_timestamp() as timestamp_ntz)")
        self.shape, self.ownership = spec.projection.get("type", "scalar"), spec.ownership
        self.life = Lifecycle(spec.policy.bootstrap)
        self.life.started = True

    # Tables of the folder

    def _fs(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{at}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _batches(self, name: str) -> list[int]:
        fs, path = self._fs(name)
        return sorted(int(n[6:]) for x in (fs.listStatus(path) if fs.exists(path) else []) if (n := x.getPath().getName()).startswith("batch="))

    def _write(self, rows: DataFrame, name: str, number: int, keep: bool = False) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
        for n in [] if keep else [n for n in self._batches(name) if n <= number][:-KEEP]:
            fs, path = self._fs(f"{name}/batch={n}")
            fs.delete(path, True)

    def _read(self, name: str, kind: str, through: int) -> DataFrame:
        """A table as it is after the last batch up to one; empty if there was none."""
        there = [n for n in self._batches(name) if n <= through]
        if not there:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.folder}/{name}/batch={there[-1]}")

    # Pause

    def pause(self) -> None:
        """From the next batch on, changes are taken in and nothing is compared, also by other processes on this folder, until resume()."""
        fs, path = self._fs("paused")
        fs.mkdirs(path)

    def resume(self) -> None:
        fs, path = self._fs("paused")
        fs.delete(path, True)

    @property
    def paused(self) -> bool:
        fs, path = self._fs("paused")
        return fs.exists(path)

    # A batch

    def batch(self, raw: DataFrame, number: int) -> dict:
        """One micro-batch of frames (topic, payload): order, judge, fold, then compare if there is a store. Returns the status, which is also written."""
        with scratch(self.spark):
            return self._batch(raw, number)

    def _batch(self, raw: DataFrame, number: int) -> dict:
        spark, p = self.spark, self.spec.policy
        now = spark.range(1).select(self.now.alias("t")).first().t
        before = self._last_status(number - 1)
        part, row = F.spark_partition_id().cast("long"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        fits = (part < 1 << PART_BITS) & (row < 1 << ROW_BITS)
        place = F.when(fits, F.shiftleft(part, ROW_BITS) + row).otherwise(F.raise_error(F.lit("a batch has too many partitions or rows")).cast("long"))
        size = 1 << PART_BITS + ROW_BITS
        at = place + (2 * number + 1) * size
        raw = raw.drop("observed_at") if "signal" in raw.columns else raw.drop("observed_at").withColumn("signal", F.lit(None).cast("string"))
        rows = run.prepared(run.decode(raw.withColumn("arrival", at), self.spec), self.spec).select(*NAMES, "err", "problem", "signal")
        # A signal of its source is no frame, only a reason for suspicion.
        all_ = stored(rows.withColumns({c: F.when(F.col("signal").isNull(), F.col(c)) for c in ("err", "problem")}), "frames")
        rows, signals = all_.filter("signal is null"), all_.filter("signal is not null")
        good = rows.filter("err is null and problem is null").select(NAMES).withColumn("fresh", F.lit(True))
        # A publisher's held events are in one file, in their order; their arrivals come before all others of this batch.
        held = self._read("held", EVENT, number - 1).withColumns({"fresh": F.lit(False), "arrival": place + 2 * number * size})
        window = 0 if self.spec.commutative else p.reorder_us
        micros = spark.range(1).select(F.unix_micros(F.lit(now).cast("timestamp")).alias("t")).first().t
        found = stored(judge(good.unionByName(held), self._read("publishers", TRACKERS, number - 1), micros, window), "judged")
        # The publishers seen last stay, at most so many, which is what bounds all that is collected of them.
        after = found.filter("role = 'tracker'").select("publisher", "tracker").withColumn("t", F.from_json("tracker", TRACKER))
        after = stored(after.orderBy(F.col("t.last_seen").desc_nulls_last(), "publisher").limit(p.max_publishers), "trackers")
        waiting = found.filter("role = 'held'").select(NAMES).join(after.select("publisher"), "publisher", "left_semi")
        judged, errors = found.filter("role = 'event'"), rows.filter("err is not null")
        seen = after.agg(
            F.count(F.lit(1)).alias("publishers"), F.sum(F.expr("aggregate(t.gaps, 0L, (a, g) -> a + g[1] - g[0] + 1)")).alias("missing"), F.sum("t.restarts").alias("restarts"),
            F.count_if("t.truncated").alias("truncated_gaps"), F.max(F.abs("t.skew_us")).alias("skew_us"),
        )
        kinds = found.groupBy("role", "verdict").agg(F.count(F.lit(1)).alias("n"))
        faults = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("err").isNotNull()).alias("e"), F.count_if(F.col("problem").isNotNull()).alias("p"))
        changed, seen, kinds, bad, n_signals, *_ = together(
            lambda: self._trusted(number, judged, errors, signals), seen.first, kinds.collect, faults.first, signals.count, lambda: self._write(after.select("publisher", "tracker"), "publishers", number),
            lambda: self._write(waiting.repartition("publisher").sortWithinPartitions("publisher", "arrival"), "held", number),
        )
        first = changed["first_clear"]
        awaiting = bool(before.get("awaiting", p.bootstrap == "Strict"))
        if awaiting:
            early = F.lit(True) if first is None else F.col("arrival") < first
            judged = judged.withColumn("stamp", F.when(early, "suspect").otherwise(F.col("stamp")))
        awaiting = awaiting and first is None
        status = self._folded(number, judged, now) | {"snapshots": changed["snapshots"]} | {k: v or 0 for k, v in seen.asDict().items()}
        verdict = {r.verdict: r.n for r in kinds if r.role == "event"}
        n_held, good_now = sum(r.n for r in kinds if r.role == "held"), bad["all"] - bad.e - bad.p
        status |= {
            "batch": number, "at": now, "received": bad["all"], "applied": sum(n for v, n in verdict.items() if v in sequence.ACCEPTED), "decode_errors": bad.e, "validation_errors": bad.p,
            "duplicates": verdict.get("duplicate", 0), "stale": verdict.get("stale_epoch", 0), "late": verdict.get("late_fill", 0), "gap_events": verdict.get("with_gap", 0),
            "gap_signals": verdict.get("with_gap", 0) + verdict.get("after_restart", 0) + bad.e + n_signals, "source_signals": n_signals, "held": n_held, "held_released": sum(verdict.values()) - good_now + n_held, "awaiting": awaiting,
        }
        self.life.awaiting, self.life.paused = awaiting, self.paused
        return self._swept(number, status, now, before)

    def _trusted(self, number: int, judged: DataFrame, errors: DataFrame, signals: DataFrame) -> dict:
        """Write what trust depends on after this batch."""
        old = self._read("trust", TRUST, number - 1)
        cleared = trust.clears(judged.filter(sequence.accepted(F.col("verdict"))), self.ownership)
        new = trust.latest(trust.marks(judged, self.ownership, errors=errors, signals=signals), cleared)
        self._write(old.unionByName(new).groupBy("pattern").agg(F.max("marked").alias("marked"), F.max("cleared").alias("cleared")), "trust", number)
        ends = cleared.agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")).first()
        return {"first_clear": ends.first, "snapshots": ends.n}

    def _folded(self, number: int, judged: DataFrame, now: datetime) -> dict:
        """Write the expected state after this batch: that before it, or what the store holds at the start, with the batch's changes."""
        p, spark = self.spec.policy, self.spark
        skipped = 0
        if not [n for n in self._batches("entries") if n < number] and p.bootstrap == "Adopt" and self.store:
            # Written before anything else is done with it, so a start that is broken off goes on with the same baseline.
            if -1 not in self._batches("entries"):
                kept = run.read_store(spark, self.store)
                entries, members = ledger.adopted(kept, self.shape, F.lit(now), p.max_keys)
                self._write(members, "members", -1)
                self._write(entries, "entries", -1)
                skipped = max(0, reconcile.typed(kept, self.shape).filter("kind not in ('absent', 'wrong_type')").count() - p.max_keys)
        entries, members = self._read("entries", ledger.ENTRY, number - 1), self._read("members", ledger.MEMBER, number - 1)
        applied = judged.filter(sequence.accepted(F.col("verdict"))).filter(validate.touches_key(F.col("op"))).select(*NAMES, "stamp")
        usable = ledger.changes(applied, self.shape)
        new, members = ledger.merged(entries, members, usable, self.shape, p.ring)
        new, members = new.select(ledger.COLUMNS), members if self.shape == "set" else None
        _, n, all_, good = together(lambda: self._write(new, "entries", number), lambda: members and self._write(members, "members", number), applied.count, usable.count)
        entries = self._read("entries", ledger.ENTRY, number)
        wrong, evicted = all_ - good, max(0, entries.count() - p.max_keys)
        if evicted:
            # Rare: those written last stay, once more through a table of their own.
            self._write(stored(state.within_capacity(entries, p.max_keys), "kept"), "entries", number)
            if members:
                entries = self._read("entries", ledger.ENTRY, number)
                self._write(stored(self._read("members", ledger.MEMBER, number).join(entries.select("key"), "key", "left_semi"), "kept"), "members", number)
        return {"evicted": evicted, "adopt_skipped": skipped, "projection_errors": wrong}

    # The expectation, and what it is compared with

    def known(self, through: int | None = None, now: Column | None = None, window_us: int | None = None) -> DataFrame:
        """The expectation after a batch, the last one if none is given, with expiry, settlement and trust."""
        p = self.spec.policy
        through = 1 << 62 if through is None else through
        rows = ledger.known(self._read("entries", ledger.ENTRY, through), self._read("members", ledger.MEMBER, through), self.shape, p.max_members)
        now = self.now if now is None else now
        rows = state.settled(state.expired(rows, now), now, p.window_us if window_us is None else window_us, p.max_window_us, p.never_settled)
        rows = rows.withColumn("is_settled", F.col("is_settled") & ~F.col("is_truncated"))
        return trust.effective(rows, self._read("trust", TRUST, through), self.ownership)

    def _swept(self, number: int, status: dict, now: datetime, before: dict) -> dict:
        p, at = self.spec.policy, F.lit(now)
        window = before.get("window_us") or (p.min_window_us if p.mode == "adaptive" else p.window_us)
        status |= {k: before.get(k) for k in ("window_moved_at", "extras_at")} | {k: before.get(k) or 0 for k in ("window_changes", "sweeps", "sweeps_skipped", "extra_scans")}
        comparing = bool(self.store) and not self.life.paused
        known, kept = together(lambda: stored(self.known(number, at, window), "known"), lambda: self._kept() if comparing else None)
        # A store that can not be read is no reason to stop taking changes in.
        reachable = kept is not None if comparing else before.get("reachable", True)
        comparing, self.life.connected = comparing and reachable, reachable
        more = known.agg(F.count_if("is_expired").alias("expired"), F.count_if(F.col("trust") == "adopted").alias("adopted"), F.count_if((F.col("writers") > 1)).alias("multi_writers"))
        seen, more, *found = together(
            state.counts(known, at, window, p.never_settled).first, more.first, *([
                lambda: self._compared(number, known, kept, now, window), lambda: self._extras(number, known, kept, now, window, status),
                lambda: self._adapted(number, known, kept, now, window, status) if p.mode == "adaptive" else {},
            ] if comparing else []),
        )
        status |= {k: v for k, v in (seen.asDict() | more.asDict()).items()}
        if self.shape == "set" or self.spec.commutative or self.ownership:
            status["multi_writers"] = 0  # several writers are no danger to these
        status |= {"phase": self.life.phase, "paused": self.life.paused, "reachable": reachable, "coverage": round(seen.settled / seen["keys"], 6) if seen["keys"] else 1.0, "window_us": window, "adaptive": False}
        if comparing:
            for x in found:
                status |= x
            status["sweeps"] += 1
        elif self.store:
            status["sweeps_skipped"] += 1
        row = [status.get(f.split()[0]) for f in STATUS.split(", ")]
        self._write(self.spark.createDataFrame([tuple(row)], STATUS).coalesce(1), "status", number, keep=True)
        return {f.split()[0]: v for f, v in zip(STATUS.split(", "), row) if v is not None}

    def _kept(self) -> DataFrame | None:
        """What the store holds, or None if it can not be read now."""
        try:
            return stored(run.read_store(self.spark, self.store), "store")
        except (PySparkException, Py4JJavaError):
            return None

    def _compared(self, number: int, known: DataFrame, kept: DataFrame, now: datetime, window: int) -> dict:
        """Settled keys that are stored otherwise. They wait for a window, and are confirmed by a second look."""
        p, at = self.spec.policy, F.lit(now)
        forgiven = reconcile.suppressed(p.expiry, F.col("last_event_at"), at, p.assumed_ttl_us)
        found = stored(reconcile.sweep(known, kept, self.shape, forgiven, at, self.spec.tolerance_us).withColumn("first_seen", at), "findings")
        queue, open_ = self._read("queue", QUEUE, number - 1), self._read("episodes", QUEUE, number - 1)
        is_due = state.plus(F.col("first_seen"), window) <= at
        due, waiting = queue.filter(is_due), queue.filter(~is_due)
        read = reconcile.typed(kept, self.shape)
        look = read.filter("kind <> 'absent'").select("key", F.when(F.col("kind") == "wrong_type", "other").otherwise("string").alias("stored_type"), reconcile.shown(self.shape).alias("scalar"))
        looked = stored(confirm.outcomes(due, known, look, found.filter("category = 'ttl_mismatch'")), "looked")
        # An episode ends when its key agrees again or was written since.
        still = open_.join(found.select("key", "version"), ["key", "version"], "left_semi")
        fresh = looked.filter("outcome = 'confirmed'").join(found.select("key"), "key", "left_semi").join(still.select("key"), "key", "left_anti").select(*still.columns)
        episodes = stored(still.unionByName(fresh), "episodes")
        new = found.join(episodes.select("key"), "key", "left_anti")
        # A key keeps its place in the queue as long as it disagrees.
        waiting = waiting.join(new.select("key"), "key", "left_semi")
        sums = found.agg(F.count(F.lit(1)).alias("divergent"), F.count_if(F.col("trust") == "suspect").alias("suspect"))
        _, _, _, outcome, sums, opened, n_open, n_before, dropped, compared, n_kept = together(
            lambda: self._write(confirm.candidates(new, waiting, p.max_queue), "queue", number), lambda: self._write(episodes, "episodes", number), lambda: self._write(reconcile.capped(found, p.max_findings), "findings", number),
            looked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect, sums.first, fresh.count, episodes.count, open_.count, confirm.overflow(new, waiting, p.max_queue).first,
            known.filter("is_settled and trust <> 'adopted'").count, kept.count,
        )
        outcome = {r.outcome: r.n for r in outcome}
        return {
            "compared": compared, "stored": n_kept, "divergent": sums.divergent, "suspect": sums.suspect, "divergent_kept": min(sums.divergent, p.max_findings), "queue": self._read("queue", QUEUE, number).count(),
            "queue_dropped": dropped.dropped, "confirmed": outcome.get("confirmed", 0), "transient": sum(n for k, n in outcome.items() if k != "confirmed"),
            "episodes": n_open, "opened": opened, "resolved": n_before - (n_open - opened),
        }

    def _extras(self, number: int, known: DataFrame, kept: DataFrame, now: datetime, window: int, status: dict) -> dict:
        """Stored keys that nothing is known of, every now and then: parked at one look, reported if they are still there a window later."""
        p = self.spec.policy
        reported, parked = self._read("extras", FINDINGS, number - 1), self._read("parked", PARKED, number - 1)
        last = status.get("extras_at")
        read = reconcile.typed(kept, self.shape).filter("kind not in ('absent', 'wrong_type')").select("key", reconcile.shown(self.shape).alias("stored"))
        unknown = stored(reconcile.extras(read, known), "unknown")
        # What was reported and is known or gone by now is no extra any more.
        reported = reported.join(unknown.select("key"), "key", "left_semi")
        out = {"extras_resolved": 0}
        if last is None or (now - last).total_seconds() * 1_000_000 >= p.extras_us:
            due = parked.filter(state.plus(F.col("parked_at"), window) <= F.lit(now))
            survived = due.join(unknown, "key").select("key", F.lit("extra_in_target").alias("category"), F.lit("complete").alias("trust"), F.lit(None).cast("string").alias("expected"), "stored", F.lit(0).cast("long").alias("version"), F.lit(None).cast("long").alias("user_id"), F.col("parked_at").alias("first_seen"))
            survived = stored(survived, "survived")
            out["extras_resolved"] = due.count() - survived.count()
            reported = survived.unionByName(reported.join(survived.select("key"), "key", "left_anti"))
            parked = unknown.select("key").orderBy("key").limit(p.max_extras).withColumn("parked_at", F.lit(now))
            out |= {"extras_at": now, "extra_scans": status["extra_scans"] + 1}
        _, _, total = together(lambda: self._write(reported, "extras", number), lambda: self._write(parked, "parked", number), unknown.count)
        n = together(self._read("extras", FINDINGS, number).count, self._read("parked", PARKED, number).count)
        return out | {"extras": n[0], "extras_parked": n[1], "extras_total": total}

    def _adapted(self, number: int, known: DataFrame, kept: DataFrame, now: datetime, window: int, status: dict) -> dict:
        """Look how long the store took to follow the changes of sampled keys, and set the window to that."""
        p, at = self.spec.policy, F.lit(now)
        control = lag.Controller(p.min_window_us, p.max_window_us, p.safety)
        seen = self._read("lags", LAGS, number - 1)
        open_ = self._read("probes", PROBES, number - 1)
        own = known.filter(F.col("last_order") >= 2 * number * (1 << PART_BITS + ROW_BITS))  # those that this batch changed
        new = lag.sample(own, number).join(known.select("key", "version", F.col("last_event_at").alias("event_at")), "key").select("key", "version", "event_at")
        probes = stored(open_.unionByName(new.join(open_.select("key"), "key", "left_anti")), "probes")
        read = reconcile.typed(kept, self.shape).select("key", F.col("kind").alias("k2"), reconcile.shown(self.shape).alias("v2"))
        looked = probes.join(known.select("key", F.col("version").alias("v"), "kind", "value"), "key", "left").join(read, "key", "left")
        follows = (F.col("kind") == F.coalesce("k2", F.lit("absent"))) & F.col("value").eqNullSafe(F.col("v2"))
        looked = looked.withColumns({"superseded": ~F.col("version").eqNullSafe(F.col("v")), "applied_at": F.when(follows, at)})
        looked = stored(lag.convergence(looked).withColumn("late", F.timestamp_diff("MICROSECOND", F.col("event_at"), at) >= lag.CAP_US), "looked")
        done = looked.filter("applied_at is not null or late").select(F.xxhash64("key", "version").alias("id"), at.alias("at"), "lag_us")
        seen = stored(lag.recent(seen.unionByName(done)), "lags")
        self._write(seen, "lags", number)
        self._write(looked.filter("applied_at is null and not late").select("key", "version", "event_at"), "probes", number)
        x = lag.percentiles(seen).first()
        moved_at = status.get("window_moved_at")
        since = int((now - moved_at).total_seconds() * 1_000_000) if moved_at else control.every_us
        # With too few observations the window stays as it is.
        to = control.next(x.n, x.p99, window, since) if x.n >= control.least else window
        out = {"lag_n": x.n, "lag_p50": x.p50 or 0, "lag_p99": x.p99 or 0, "probe_timeouts": looked.filter("applied_at is null and late").count(), "window_us": to, "adaptive": x.n >= control.least}
        return out | ({"window_moved_at": now, "window_changes": status["window_changes"] + 1} if to != window else {})

    # What came of it

    def _last_status(self, through: int) -> dict:
        there = [n for n in self._batches("status") if n <= through]
        return self.spark.read.schema(STATUS).parquet(f"{self.folder}/status/batch={there[-1]}").first().asDict() if there else {}

    def history(self) -> DataFrame:
        """One typed row for each batch so far."""
        return self.spark.read.schema(STATUS).parquet(*[f"{self.folder}/status/batch={n}" for n in self._batches("status")])

    def status(self) -> list[dict]:
        """The same as dictionaries, without what is not known."""
        return [{k: v for k, v in r.asDict().items() if v is not None} for r in self.history().orderBy("batch").collect()]

    def findings(self) -> DataFrame:
        """The disagreements of the last sweep, at most so many as the policy says, and the extra keys reported so far."""
        return self._read("findings", FINDINGS, 1 << 62).unionByName(self._read("extras", FINDINGS, 1 << 62))

    def metrics(self) -> DataFrame:
        """name, label, value: the metrics of the last batch, sums over all batches where a metric is a total, and those of each publisher."""
        rows = self.history()
        last = rows.orderBy(F.desc("batch")).limit(1)
        totals = rows.agg(*[F.sum(c).alias(c) for c in metrics.SUMMED])
        publishers = self._read("publishers", TRACKERS, 1 << 62).select("publisher", F.from_json("tracker", TRACKER).alias("t"))
        return metrics.of_watch(last, totals, publishers)

    def _told(self) -> DataFrame:
        rows = metrics.of_history(self.history(), self.folder)
        return rows.withColumns({"saturated": F.col("evicted") > 0, "commutative": F.lit(self.spec.commutative or self.shape != "counter"), "sweep_us": F.lit(self.spec.policy.sweep_us)})

    def conditions(self) -> DataFrame:
        """id, type, status: the conditions of this audit after the last batch."""
        return metrics.conditions(self._told().orderBy(F.desc("batch")).limit(1))

    def transitions(self) -> DataFrame:
        """id, at, event: what changed from one batch to the next."""
        return metrics.transitions(self._told())

    def alerts(self) -> DataFrame:
        """id, at, alert, since, fires: the conditions of the alert rules that hold after the last batch."""
        rows = metrics.holding(self._told())
        return rows.join(F.broadcast(self.history().agg(F.max("at").alias("at"))), "at", "left_semi").select("id", "at", "alert", "since", "fires")

    def start(self, frames: DataFrame, once: bool = False) -> StreamingQuery:
        writer = frames.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(lambda rows, n: self.batch(rows, n) and None)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{self.spec.policy.sweep_us // 1000} milliseconds")).start()
