"""Why one key disagrees: a verdict, and rules with a confidence for each likely cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
HIGH_PRESSURE = 90
# The codes of diagnoses. What they say is ours.
SAYS = {
    "AGREE": "the store holds what is expected, and the key is settled",
    "IN_FLIGHT": "the key changed within the settlement window, so a difference may be lag",
    "SEQ_GAP_AFFECTING_PUBLISHER": "its publisher's stream lost numbers, so the expectation may lack a change",
    "MISSING_IN_TARGET_NO_GAPS": "nothing was lost on the way to the auditor, yet the store lacks the key",
    "EXTRA_IN_TARGET": "the store holds a key that no change explains",
    "PUBLISHER_RESTARTED": "its publisher started again, so changes before may have been lost",
    "TARGET_EVICTION_LIKELY": "the store is full and evicts keys",
    "TARGET_EVICTION_POSSIBLE": "the store has evicted keys",
    "TTL_EXPIRED": "the key's lifetime is over",
    "TYPE_MISMATCH": "the store holds another type under this key",
    "CLOCK_SKEW_HIGH": "its publisher's clock is further off than the settlement window",
    "MEMBER_SUBSET": "the stored set only lacks members: changes did not arrive",
    "MEMBER_SUPERSET": "the stored set only has more members: removals did not arrive",
    "HISTORY_TRUNCATED": "there were more changes than the history keeps",
    "NO_HISTORY": "no change of this key was seen",
}


def verdict(c: dict[str, Column]) -> Column:
    """unknown, unreadable, in_flight, suspect, agrees or diverges, in this order."""
    return (
        F.when(~c["known"] & ~c["stored"], "unknown").when(~c["readable"], "unreadable").when(c["known"] & ~c["settled"], "in_flight")
        .when(c["trust"] == "suspect", "suspect").when(c["equal"], "agrees").otherwise("diverges")
    )


def rules(c: dict[str, Column]) -> dict[str, tuple[str, Column]]:
    """Code -> confidence and condition, over one row for each key with everything that is known about it."""
    gone = c["known"] & (c["kind"] != "absent") & ~c["stored"]
    restart = F.when(c["restarted"], True).otherwise(False)
    return {
        "AGREE": ("high", c["settled"] & c["equal"] & c["readable"]),
        "IN_FLIGHT": ("high", c["known"] & ~c["settled"]),
        "SEQ_GAP_AFFECTING_PUBLISHER": ("high", c["publisher_missing"] > 0),
        "MISSING_IN_TARGET_NO_GAPS": ("high", gone & c["settled"] & c["reachable"] & (c["trust"] == "complete") & (c["publisher_missing"] == 0)),
        "EXTRA_IN_TARGET": ("medium", c["stored"] & (~c["known"] | (c["kind"] == "absent"))),
        "PUBLISHER_RESTARTED": ("medium", restart),
        "TARGET_EVICTION_LIKELY": ("high", gone & (c["pressure"] >= HIGH_PRESSURE) & (c["evicted"] > 0)),
        "TARGET_EVICTION_POSSIBLE": ("low", gone & (c["pressure"] < HIGH_PRESSURE) & (c["evicted"] > 0)),
        "TTL_EXPIRED": ("high", c["expired"] & ~c["stored"]),
        "TYPE_MISMATCH": ("high", ~c["readable"] & c["stored"]),
        "CLOCK_SKEW_HIGH": ("medium", F.abs(c["skew_us"]) > c["window_us"]),
        "HISTORY_TRUNCATED": ("low", c["history"] >= c["ring"]),
        "NO_HISTORY": ("medium", c["history"] == 0),
    }


def diagnoses(facts: DataFrame) -> DataFrame:
    """key, place, code, confidence: what explains each key, the surest first, then by code."""
    made = rules({n: F.col(n) for n in facts.columns})
    held = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct((-F.lit(CONFIDENCE[level])).alias("rank"), F.lit(code).alias("code"), F.lit(level).alias("confidence"))) for code, (level, cond) in made.items()]), lambda x: x.isNotNull())
    return facts.select("key", F.posexplode(F.array_sort(held)).alias("pos", "d")).select("key", (F.col("pos") + 1).cast("long").alias("place"), "d.code", "d.confidence")


def steps(history: DataFrame) -> DataFrame:
    """history with the microseconds since the change before."""
    w = Window.partitionBy("key").orderBy("place")
    return history.withColumn("since_us", F.timestamp_diff("MICROSECOND", F.lag("observed_at").over(w), F.col("observed_at")))


def member_rule(missing: Column, unexpected: Column) -> Column:
    """MEMBER_SUBSET if only members lack, MEMBER_SUPERSET if there are only too many, or null."""
    return F.when((missing > 0) & (unexpected == 0), "MEMBER_SUBSET").when((missing == 0) & (unexpected > 0), "MEMBER_SUPERSET")
