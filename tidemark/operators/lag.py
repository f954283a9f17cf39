"""How long the store takes to follow: samples, percentiles, and the settlement window that follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, CAP_US, WINDOW_ROWS = 200, 60_000_000, 10_000
# Bounds of a histogram's buckets in milliseconds.
BUCKETS_MS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10_000, 30_000, 60_000, 120_000)


def sample(keys: DataFrame, seed: int, k: int = SAMPLE) -> DataFrame:
    """k keys, uniform by a seeded hash: a top-k, the same for the same seed."""
    return keys.select("key").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "key")), "key").limit(k)


def convergence(probes: DataFrame) -> DataFrame:
    """probes (event_at, applied_at) with lag_us: time until the store followed, at the cap where it never did; superseded probes go."""
    lag = F.timestamp_diff("MICROSECOND", F.col("event_at"), F.col("applied_at"))
    return probes.filter("not superseded").withColumn("lag_us", F.least(F.coalesce(lag, F.lit(CAP_US)), F.lit(CAP_US)))


def recent(observations: DataFrame, n: int = WINDOW_ROWS) -> DataFrame:
    return observations.orderBy(F.desc("at"), F.desc("id")).limit(n)


def percentiles(observations: DataFrame, value: str = "lag_us") -> DataFrame:
    """One row of nearest-rank percentiles: n, p50, p90, p99, max."""
    p = lambda q: F.expr(f"cast(percentile_disc({q}) within group (order by {value}) as bigint)")
    return observations.agg(F.count(value).alias("n"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max(value).alias("max"))


def histogram(observations: DataFrame, value_ms: Column) -> DataFrame:
    """le, n: observations at or below each bucket's bound, cumulative."""
    bounds = F.explode(F.array(*[F.lit(b).cast("long") for b in BUCKETS_MS])).alias("le")
    counted = observations.agg(*[F.count_if(value_ms <= b).alias(str(b)) for b in BUCKETS_MS])
    return counted.select("*", bounds).select("le", F.element_at(F.create_map(*[x for b in BUCKETS_MS for x in (F.lit(b).cast("long"), F.col(str(b)))]), F.col("le")).alias("n"))


@dataclass
class Controller:
    """The adaptive window: a multiple of the 99th percentile within limits, moved only when it differs enough and not too often."""

    floor_us: int = 1_000_000
    ceiling_us: int = 120_000_000
    safety: float = 3.0
    least: int = 100
    change: float = 0.2
    every_us: int = 60_000_000

    def want(self, p99: Column) -> Column:
        return F.least(F.greatest((p99 * F.lit(self.safety)).cast("long"), F.lit(self.floor_us).cast("long")), F.lit(self.ceiling_us).cast("long"))

    def step(self, n: Column, p99: Column, current: Column, since_us: Column) -> Column:
        """The next window from the number of observations, their p99, the window in use and the time since it last moved."""
        want = self.want(p99)
        far = F.abs(want - current) > current * F.lit(self.change)
        return F.when(n < self.least, F.lit(self.floor_us).cast("long")).when(far & (since_us >= self.every_us), want).otherwise(current)

    def next(self, n: int, p99: int, current: int, since_us: int) -> int:
        """The same on plain numbers, for the driver of a stream."""
        if n < self.least:
            return self.floor_us
        want = min(max(int(p99 * self.safety), self.floor_us), self.ceiling_us)
        return want if abs(want - current) > current * self.change and since_us >= self.every_us else current
