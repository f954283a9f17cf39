"""Metrics as rows, and what follows from them: phases, conditions, alerts, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import running

MAX_LABELS = 50
# Kinds of metrics, by name.
COUNTERS = """events_received_total events_dropped_total bytes_received_total seq_gaps_total publisher_restarts_total oracle_evictions_total
projection_errors_total target_errors_total target_evictions_observed_total target_expirations_observed_total drift_episodes_total
drift_resolved_total transient_divergence_total confirm_queue_dropped_total sweeps_total sweeps_skipped_total lag_probe_timeouts_total
source_reconnects_total panics_total""".split()
GAUGES = """ingest_queue_depth seq_missing_events seq_epoch seq_high_water_mark publisher_clock_skew_seconds publishers_tracked gapset_truncated
oracle_keys oracle_settled_keys oracle_inflight_keys oracle_never_settled_keys target_reachable target_keyspace_size target_role divergent_keys
suspect_divergent_keys advisory_divergent_keys drift_duration_seconds confirm_queue_depth sweep_keys_compared coverage_ratio
settlement_window_seconds source_connected build_info checks_active""".split()
HISTOGRAMS = "oracle_apply_duration_seconds target_read_duration_seconds sweep_duration_seconds convergence_seconds".split()
# Names of metrics, with the field of a status row that each shows and the factor between their units.
OF_STATUS = {
    "events_received_total": ("received", 1), "seq_gaps_total": ("gap_events", 1), "seq_missing_events": ("missing", 1), "publisher_restarts_total": ("restarts", 1),
    "publishers_tracked": ("publishers", 1), "oracle_keys": ("keys", 1), "oracle_settled_keys": ("settled", 1), "oracle_inflight_keys": ("in_flight", 1), "oracle_never_settled_keys": ("never_settled", 1),
    "divergent_keys": ("divergent", 1), "suspect_divergent_keys": ("suspect", 1), "confirm_queue_depth": ("queue", 1), "confirm_queue_dropped_total": ("queue_dropped", 1),
    "sweep_keys_compared": ("settled", 1), "coverage_ratio": ("coverage", 1), "settlement_window_seconds": ("window_us", 1e-6), "target_keyspace_size": ("stored", 1),
}
# Names of metrics, with the field of a running audit's last status that each shows, the factor between their units, and the sum over all batches where it is a total.
OF_WATCH = {
    "oracle_keys": ("keys", 1), "oracle_settled_keys": ("settled", 1), "oracle_inflight_keys": ("in_flight", 1), "oracle_never_settled_keys": ("never_settled", 1), "target_keyspace_size": ("stored", 1),
    "divergent_keys": ("divergent", 1), "suspect_divergent_keys": ("suspect", 1), "confirm_queue_depth": ("queue", 1), "sweep_keys_compared": ("compared", 1), "coverage_ratio": ("coverage", 1),
    "settlement_window_seconds": ("window_us", 1e-6), "publishers_tracked": ("publishers", 1), "ingest_queue_depth": ("held", 1), "sweeps_total": ("sweeps", 1), "sweeps_skipped_total": ("sweeps_skipped", 1),
    "target_reachable": ("reachable", 1), "advisory_divergent_keys": ("extras", 1), "convergence_seconds": ("lag_p99", 1e-6),
}
TOTALS = {
    "events_received_total": ("received",), "events_dropped_total": ("decode_errors", "validation_errors", "duplicates", "stale"), "seq_gaps_total": ("gap_events",), "oracle_evictions_total": ("evicted",),
    "projection_errors_total": ("projection_errors",), "drift_episodes_total": ("opened",), "drift_resolved_total": ("resolved",), "transient_divergence_total": ("transient",),
    "confirm_queue_dropped_total": ("queue_dropped",), "lag_probe_timeouts_total": ("probe_timeouts",),
}
OF_PUBLISHERS = {"seq_missing_events": "aggregate(t.gaps, 0L, (a, g) -> a + g[1] - g[0] + 1)", "seq_epoch": "t.epoch", "seq_high_water_mark": "t.high", "publisher_clock_skew_seconds": "t.skew_us / 1e6", "publisher_restarts_total": "t.restarts", "gapset_truncated": "int(t.truncated)"}
SUMMED = [c for cs in TOTALS.values() for c in cs]
PHASES = ("Paused", "AwaitingSnapshot", "Failed", "Degraded", "Watching")


def long_form(row: DataFrame, labels: Column | None = None) -> DataFrame:
    """name, label, value from a table of numeric columns: one row for each column and row."""
    label = F.lit("") if labels is None else labels
    names = [f.name for f in row.schema.fields if f.dataType.typeName() in ("long", "integer", "double", "boolean")]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names]))
    return row.select(label.alias("label"), pairs.alias("p")).select("p.name", "label", "p.value")


def of_status(row: DataFrame) -> DataFrame:
    """name, label, value: the metrics that a status row gives, by their public names."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit("").alias("label"), (F.col(c).cast("double") * k).alias("value")) for n, (c, k) in OF_STATUS.items()])))


def of_watch(last: DataFrame, totals: DataFrame, publishers: DataFrame) -> DataFrame:
    """name, label, value from the last status and the sums of a running audit, and its publishers (publisher, t)."""
    one = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit("").alias("label"), v.cast("double").alias("value"))
    now = last.select(F.inline(F.array(*[one(n, F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * k) for n, (c, k) in OF_WATCH.items()])))
    sums = totals.select(F.inline(F.array(*[one(n, sum((F.coalesce(F.col(c), F.lit(0)) for c in cs), F.lit(0))) for n, cs in TOTALS.items()])))
    own = publishers.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col("publisher").alias("label"), F.coalesce(F.expr(x).cast("double"), F.lit(0.0)).alias("value")) for n, x in OF_PUBLISHERS.items()])))
    return now.unionByName(sums).unionByName(own)


def bounded_labels(rows: DataFrame, label: str, first: str, most: int = MAX_LABELS) -> DataFrame:
    """rows with all labels but the first so many (by when they were first seen) replaced by __other__."""
    seen = rows.groupBy(label).agg(F.min(first).alias("__f")).orderBy("__f", label).limit(most).select(label, F.lit(True).alias("__own"))
    return rows.join(F.broadcast(seen), label, "left").withColumn(label, F.when(F.col("__own"), F.col(label)).otherwise("__other__")).drop("__own")


def deltas(totals: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """totals with what each added to the one before; the first and any decrease add nothing. In blocks of the order (a number), so no key is one task."""
    # As fields of a struct, nulls are equal to each other.
    found = running(totals.withColumn("__key", F.struct(*keys)), ["__key"], order, {"__before": F.struct(F.col(order).alias("at"), F.col(value).alias("v"))})
    return found.withColumn("delta", F.greatest(F.coalesce(F.col(value) - F.col("__before.v"), F.lit(0)), F.lit(0))).drop("__before", "__key")


def coverage(compared: Column, tracked: Column) -> Column:
    return F.when(tracked == 0, F.lit(1.0)).otherwise(compared / tracked)


def phase(paused: Column, awaiting: Column, failed: Column, connected: Column, saturated: Column) -> Column:
    return F.when(paused, "Paused").when(awaiting, "AwaitingSnapshot").when(failed, "Failed").when(~connected | saturated, "Degraded").otherwise("Watching")


def conditions(status: DataFrame) -> DataFrame:
    """id, type, status: all conditions of each status row."""
    made = {
        "Ready": F.col("phase").isin("Watching", "Paused", "Degraded"), "SourceConnected": F.col("connected"), "TargetAvailable": F.col("reachable"),
        "DriftDetected": F.col("divergent") > 0, "OracleSaturated": F.col("saturated"), "SequenceIntegrity": F.col("missing") == 0,
        "AwaitingSnapshot": F.col("phase") == "AwaitingSnapshot", "MultiWriterUnsafe": F.col("multi_writers") > 0,
        "ProjectionNotCommutative": ~F.col("commutative"), "SweepIntervalTight": F.col("sweep_us") < 2 * F.col("window_us"),
    }
    return status.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), v.alias("status")) for k, v in made.items()])).alias("c")).select("id", "c.*")


def transitions(history: DataFrame) -> DataFrame:
    """id, at, event: what changed from one status to the next."""
    w = Window.partitionBy("id").orderBy("at")
    before = history.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("divergent", "connected", "reachable", "phase")})
    events = F.array(
        F.when((F.col("divergent") > 0) & (F.coalesce("p_divergent", F.lit(0)) == 0), "DriftDetected"), F.when((F.col("divergent") == 0) & (F.col("p_divergent") > 0), "DriftResolved"),
        F.when(~F.col("connected") & F.coalesce("p_connected", F.lit(True)), "SourceLost"), F.when(F.col("connected") & ~F.col("p_connected"), "SourceRestored"),
        F.when(~F.col("reachable") & F.coalesce("p_reachable", F.lit(True)), "TargetLost"), F.when(F.col("reachable") & ~F.col("p_reachable"), "TargetRestored"),
        F.when((F.col("phase") == "Paused") & (F.col("p_phase") != "Paused"), "Paused"), F.when((F.col("phase") != "Paused") & (F.col("p_phase") == "Paused"), "Resumed"),
    )
    return before.select("id", "at", F.explode(F.filter(events, lambda x: x.isNotNull())).alias("event"))


def rules() -> dict[str, Column]:
    """Whether the condition of each alert rule holds, from the columns of a status row."""
    # Names of the alert rules.
    return {
        "drift_detected": F.col("divergent") > 0, "drift_severe": F.col("divergent") > 0.01 * F.col("complete_keys"), "event_loss": F.col("gap_rate") > 0,
        "back_pressure": F.col("buffer_full_rate") > 0, "saturated": F.col("eviction_rate") > 0, "low_coverage": F.col("coverage") < 0.8,
        "target_unavailable": ~F.col("reachable"), "source_disconnected": ~F.col("connected"), "window_at_max": F.col("window_us") >= 120_000_000, "sweeps_skipped": F.col("skipped_rate") > 0,
    }


#: For how many seconds the condition of each rule must hold before it fires, and over how many a rate looks back.
HOLD_S = {
    "drift_detected": 300, "drift_severe": 300, "event_loss": 600, "back_pressure": 300, "saturated": 300, "low_coverage": 900, "target_unavailable": 120, "source_disconnected": 120, "window_at_max": 600,
    "sweeps_skipped": 600,
}
RATE_S = {"gap_rate": ("gap_events", 600), "buffer_full_rate": ("source_signals", 300), "eviction_rate": ("evicted", 300), "skipped_rate": ("skipped", 600)}


def alerts(status: DataFrame) -> DataFrame:
    """id, alert: the conditions of the alert rules that hold in each status row, however long they have."""
    return status.select("id", F.explode(F.filter(F.array(*[F.when(v, k) for k, v in rules().items()]), lambda x: x.isNotNull())).alias("alert"))


def holding(history: DataFrame) -> DataFrame:
    """id, at, alert, since, fires: for each status row (id, at and what the rules look at) the conditions that hold, since when without a break, and whether that is long enough.

    A history has one row for each sweep of an audit; each audit's own is ordered.
    """
    made = F.array(*[F.struct(F.lit(k).alias("alert"), F.coalesce(v, F.lit(False)).alias("holds"), F.lit(HOLD_S[k]).alias("hold_s")) for k, v in rules().items()])
    rows = history.select("id", "at", F.explode(made).alias("r")).select("id", "at", "r.*")
    w = Window.partitionBy("id", "alert").orderBy("at")
    rows = rows.withColumn("__run", F.sum((~F.col("holds")).cast("int")).over(w)).filter("holds")
    since = F.min("at").over(Window.partitionBy("id", "alert", "__run"))
    return rows.withColumn("since", since).select("id", "at", "alert", "since", (F.timestamp_diff("MICROSECOND", F.col("since"), F.col("at")) >= F.col("hold_s") * F.lit(1_000_000).cast("long")).alias("fires"))


def of_history(history: DataFrame, name: str) -> DataFrame:
    """What the alert rules look at, from the status rows of a running audit; rates are whether anything happened in the time that a rule looks back."""
    rows = history.withColumns({"id": F.lit(name), "divergent": F.coalesce("divergent", F.lit(0)), "complete_keys": F.coalesce("compared", F.lit(0)) - F.coalesce("suspect", F.lit(0)), "connected": F.lit(True)})
    rows = rows.withColumn("skipped", F.coalesce(F.col("sweeps_skipped") - F.lag("sweeps_skipped").over(Window.partitionBy("id").orderBy("at")), F.lit(0)))
    at = F.unix_seconds(F.col("at").cast("timestamp"))
    back = lambda s: Window.partitionBy("id").orderBy(at).rangeBetween(-s, 0)
    return rows.withColumns({n: F.sum(F.coalesce(c, F.lit(0))).over(back(s)) for n, (c, s) in RATE_S.items()})


def exposition(rows: DataFrame) -> DataFrame:
    """Lines of the text format of metrics, from name, label, value."""
    label = F.when(F.col("label") == "", "").otherwise(F.concat(F.lit('{publisher="'), F.regexp_replace("label", r'(["\\])', r"\\$1"), F.lit('"}')))
    return rows.select(F.concat("name", label, F.lit(" "), F.col("value").cast("string")).alias("line"))
