"""Where frames come from: files of lines, envelopes, pacing, frames of sockets, signals of loss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Why a source may have lost something.
REASONS = ("reconnect", "high_water_mark", "oversized_frame", "idle_timeout")
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(read: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"source {name} is registered twice")
        REGISTRY[name] = read
        return read

    return add


@register("file")
def lines(spark: SparkSession, path: str, topic: str = "") -> DataFrame:
    """topic, payload, observed_at from files of lines; blank lines are left out."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(F.lit(topic).alias("topic"), F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("observed_at"))


@register("file_stream")
def line_stream(spark: SparkSession, path: str, topic: str = "", files_per_trigger: int = 1) -> DataFrame:
    """The same, as files arrive."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).filter(F.trim("value") != "")
    return rows.select(F.lit(topic).alias("topic"), F.col("value").alias("payload"), F.current_timestamp().alias("observed_at"))


@register("memory")
def memory(spark: SparkSession, rows: list[tuple], most: int = 4096) -> DataFrame:
    """A bounded list of (topic, payload, observed_at); one that is too long is refused, not cut."""
    if len(rows) > most:
        raise ValueError(f"{len(rows)} rows exceed the queue of {most}")
    return spark.createDataFrame(rows, "topic string, payload string, observed_at timestamp")


@register("kafka")
def kafka(spark: SparkSession, servers: str, topics: str, most: int = 100_000) -> DataFrame:
    """topic, payload, observed_at from a broker, with back-pressure by offsets; needs Spark's Kafka package."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("maxOffsetsPerTrigger", most).load()
    return rows.select("topic", F.col("value").cast("string").alias("payload"), F.col("timestamp").alias("observed_at"))


#: Bytes of a frame that a transport takes, unless told otherwise.
MAX_FRAME = 8 << 20


def capped(raw: DataFrame, most: int = MAX_FRAME) -> DataFrame:
    """raw with oversized: whether a frame is larger than its transport takes; such frames are dropped and count as a signal of loss."""
    return raw.withColumn("oversized", F.octet_length("payload") > most)


def envelope(raw: DataFrame) -> DataFrame:
    """raw with topic and ts as the payload's outermost fields say, without decoding the rest."""
    return raw.withColumns({"topic": F.get_json_object("payload", "$.topic"), "ts": F.get_json_object("payload", "$.ts")})


def paced(rows: DataFrame, at: str, speed: float) -> DataFrame:
    """rows with due_us: microseconds after the start at which a replay at this speed gives them out; 0 for as fast as possible."""
    first = rows.agg(F.min(at).alias("__first"))
    offset = F.timestamp_diff("MICROSECOND", F.col("__first"), F.col(at))
    due = F.lit(0).cast("long") if speed == 0 else F.floor(offset / speed).cast("long")
    return rows.join(F.broadcast(first)).withColumn("due_us", due).drop("__first")


def split_frames(rows: DataFrame) -> DataFrame:
    """topic and payload from the frames of a message: none is no message, one is the payload, further ones are ignored."""
    n = F.size("frames")
    found = rows.filter(n > 0)
    topic = F.when(n > 1, F.get("frames", F.lit(0))).otherwise("")
    return found.select(*[c for c in rows.columns if c != "frames"], topic.alias("topic"), F.when(n > 1, F.get("frames", F.lit(1))).otherwise(F.get("frames", F.lit(0))).alias("payload"))


def signals(rows: DataFrame) -> DataFrame:
    """arrival, reason of the losses that sources report; unknown reasons go."""
    return rows.filter(F.col("reason").isin(*REASONS)).select("arrival", "reason")


def backoff_window(attempt: int, base_s: float = 0.1, most_s: float = 30.0) -> float:
    """The seconds within which a connector waits at random before it tries again."""
    return min(base_s * 2**attempt, most_s)
