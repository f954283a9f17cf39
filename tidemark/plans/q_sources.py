"""Queries of sources and decoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codecs
from tidemark.functions.columns import parse_duration
from tidemark.plans import base, sql
from tidemark.plans.base import query
from tidemark.sources import files
from tidemark.streaming import faults

RAW = """with p as (select event_id as id, case event_id % 9 when 0 then concat('{"publisher":"', event_type, '","seq":', cast(event_id as varchar), ',"op":"set","key":"k', cast(user_id as varchar), '","value":"v"}')
    when 1 then concat('{"publisher":"', event_type, '","seq":"', cast(event_id as varchar), '","op":"ADD","key":"","member":"m","extra":[1,{"x":"}"}]}') when 2 then concat('{"publisher":"', event_type, '","seq":', cast(event_id as varchar), '.0,"op":"set"}')
    when 3 then '{"publisher":"p","op":"set"' when 4 then concat('{"op":"frob","seq":', cast(event_id as varchar), '}') when 5 then concat('{"publisher":"p","op":"delete","op":"set","seq":1,"seq":', cast(event_id as varchar), '} ')
    when 6 then concat('{"publisher":"p","op":"set"} ', event_type) when 7 then '{"publisher":"p","op":"set"}{"seq":1}' else concat('{"publisher":"p","seq":18446744073709551615,"op":"incr","delta":-', cast(event_id as varchar), '}') end as payload from events),
j as (select id, case when id % 9 in (2, 3, 6, 7) then 'malformed' when id % 9 = 4 then 'unknown_op' end as err from p)"""


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    n, seq = F.col("event_id") % 9, F.col("event_id").cast("string")
    t = F.col("event_type")
    c = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    text = (
        F.when(n == 0, c('{"publisher":"', t, '","seq":', seq, ',"op":"set","key":"k', F.col("user_id").cast("string"), '","value":"v"}'))
        .when(n == 1, c('{"publisher":"', t, '","seq":"', seq, '","op":"ADD","key":"","member":"m","extra":[1,{"x":"}"}]}'))
        .when(n == 2, c('{"publisher":"', t, '","seq":', seq, '.0,"op":"set"}')).when(n == 3, '{"publisher":"p","op":"set"').when(n == 4, c('{"op":"frob","seq":', seq, "}"))
        .when(n == 5, c('{"publisher":"p","op":"delete","op":"set","seq":1,"seq":', seq, "} ")).when(n == 6, c('{"publisher":"p","op":"set"} ', t)).when(n == 7, '{"publisher":"p","op":"set"}{"seq":1}')
        .otherwise(c('{"publisher":"p","seq":18446744073709551615,"op":"incr","delta":-', seq, "}"))
    )
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), text.alias("payload"))


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    return codecs.decode_json(_payloads(spark, d))


@query("cod_1_errors", RAW + " select err, count(*) as n from j where err is not null group by 1")
def _(spark, d):
    return _decoded(spark, d).filter("err is not null").groupBy("err").agg(F.count(F.lit(1)).alias("n"))


@query("cod_2_json", RAW + " select id, case when id % 9 in (5, 8) then 'p' else event_type end as publisher, case when id % 9 in (0, 5) then 'set' when id % 9 = 1 then 'add' else 'incr' end as op, case when id % 9 = 0 then concat('k', cast(user_id as varchar)) when id % 9 = 1 then '' end as key, case when id % 9 = 1 then 'm' end as member, case when id % 9 = 0 then 'v' end as value from j join events on id = event_id where err is null")
def _(spark, d):
    return _decoded(spark, d).filter("err is null").select("id", "publisher", "op", "key", "member", "value")


@query("cod_3_last_field_wins", RAW + " select id, cast(id as varchar) as seq from p where id % 9 = 5")
def _(spark, d):
    return _decoded(spark, d).filter("id % 9 = 5").select("id", F.col("seq").cast("string").alias("seq"))


@query("cod_4_trailing_bytes", RAW + " select id, err from j where id % 9 in (6, 7)")
def _(spark, d):
    return _decoded(spark, d).filter("id % 9 in (6, 7)").select("id", "err")


@query("cod_5_depth", "select event_id as id, case when event_id % 40 > 30 then 'too_large' end as err from events")
def _(spark, d):
    n = (F.col("event_id") % 40 + 1).cast("int")
    text = F.concat(F.lit('{"publisher":"p","op":"heartbeat","x":'), F.repeat(F.lit("["), n), F.repeat(F.lit("]"), n), F.lit("}"))
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), text.alias("payload"))
    return codecs.decode_json(rows).select("id", "err")


@query("cod_6_caps", "select event_id as id, case when event_id % 2 = 0 then 'too_large' end as err from events")
def _(spark, d):
    key = F.repeat(F.lit("k"), F.when(F.col("event_id") % 2 == 0, 4097).otherwise(4096))
    # Four kilobytes of text for each id: dealt out before they are made, as a file may have few row groups.
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id").repartition("event_id").select(F.col("event_id").alias("id"), F.concat(F.lit('{"publisher":"p","op":"delete","key":"'), key, F.lit('"}')).alias("payload"))
    return codecs.decode_json(rows).select("id", "err")


@query("cod_7_unsigned", RAW + " select id, case when id % 9 = 8 then '18446744073709551615' else cast(id as varchar) end as seq from j where id % 9 in (0, 1, 5, 8)")
def _(spark, d):
    return _decoded(spark, d).filter("err is null").select("id", F.col("seq").cast("string").alias("seq"))


@query("cod_8_signed", RAW + " select id, -id as delta from p where id % 9 = 8")
def _(spark, d):
    return _decoded(spark, d).filter("id % 9 = 8").select("id", "delta")


TIMES = """with t as (select event_id as id, ts, case event_id % 5 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 1 then cast(cast(floor(epoch(ts)) as bigint) as varchar) when 2 then cast(epoch_us(ts) // 1000 as varchar)
    when 3 then concat(cast(epoch_us(ts) as varchar), '000') else strftime(ts, '%Y-%m-%dt%H:%M:%Sz') end as text from events)"""


def _times(spark: SparkSession, d: str) -> DataFrame:
    n, at = F.col("event_id") % 5, F.col("ts").cast("timestamp")
    text = F.when(n == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, F.unix_seconds(at).cast("string")).when(n == 2, F.unix_millis(at).cast("string")).when(n == 3, F.concat(F.unix_micros(at).cast("string"), F.lit("000"))).otherwise(F.date_format("ts", "yyyy-MM-dd't'HH:mm:ss'z'"))
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), text.alias("text"))


@query("cod_9_timestamps", TIMES + " select id, case id % 5 when 4 then -1 when 3 then epoch_us(ts) when 2 then epoch_us(ts) // 1000 * 1000 else cast(floor(epoch(ts)) as bigint) * 1000000 end as micros from t")
def _(spark, d):
    return _times(spark, d).select("id", F.coalesce(F.unix_micros(codecs.timestamp(F.col("text"))), F.lit(-1)).alias("micros"))


@query("cod_10_unix_units", "select event_id as id, case when v = 0 then -1 when v < 100000000000 then v * 1000000 when v < 100000000000000 then v * 1000 else v // 1000 end as micros from (select event_id, event_id * event_id * event_id * 1000 as v from events)")
def _(spark, d):
    # Past id 209715 the number has more than 63 bits: its text is still made whole, and the decoder finds that it is no time.
    e = F.col("event_id").cast("decimal(10,0)")
    text = (e * e * e * F.lit(1000).cast("decimal(4,0)")).cast("string")
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.coalesce(F.unix_micros(codecs.timestamp(text)), F.lit(-1)).alias("micros"))


@query("cod_11_lifetimes", "select event_id as id, case event_id % 4 when 0 then event_id * 1000000 when 1 then event_id * 60000000 + 30000000 when 2 then event_id * 1000 end as ttl from events")
def _(spark, d):
    e = F.col("event_id")
    n, text = e % 4, e.cast("string")
    made = F.when(n == 0, text).when(n == 1, F.concat(text, F.lit("m30s"))).when(n == 2, F.concat(text, F.lit("ms"))).otherwise(F.concat(text, F.lit("x")))
    return spark.read.parquet(f"{d}/events.parquet").select(e.alias("id"), parse_duration(made).alias("ttl"))


@query("cod_12_foreign_ops", "select event_type, case event_type when 'click' then 'add' when 'error' then 'delete' when 'view' then 'snapshot_end' end as op, count(*) as n from events group by 1, 2")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_type") == "view", "Snapshot-End").otherwise(F.col("event_type"))
    op = codecs.operation(text, {"click": "add", "error": "delete"}, False)
    return rows.groupBy("event_type", op.alias("op")).agg(F.count(F.lit(1)).alias("n"))


@query("cod_14_aliases", RAW + " select id, publisher, publisher as member from (select id, case when id % 9 in (0, 1) then event_type else 'p' end as publisher from j join events on id = event_id where err is null)")
def _(spark, d):
    rows = codecs.decode_json(_payloads(spark, d), {"member": "publisher"})
    return rows.filter("err is null").select("id", "publisher", "member")


@query("cod_15_msgpack", "select event_id as id, event_type as publisher, cast(event_id as varchar) as seq, 'set' as op, concat('k', cast(user_id as varchar)) as key from events where event_id % 7 <> 0")
def _(spark, d):
    e = F.col("event_id")
    pack = lambda text: F.concat(F.unhex(F.hex(F.length(text) + 160)), F.encode(text, "UTF-8"))
    number = F.concat(F.unhex(F.lit("cf")), F.unhex(F.lpad(F.hex(e), 16, "0")))
    body = F.concat(F.unhex(F.lit("84")), pack(F.lit("publisher")), pack(F.col("event_type")), pack(F.lit("seq")), number, pack(F.lit("op")), pack(F.lit("set")), pack(F.lit("key")), pack(F.concat(F.lit("k"), F.col("user_id").cast("string"))))
    rows = spark.read.parquet(f"{d}/events.parquet").select(e.alias("id"), F.when(e % 7 == 0, F.substring(body, 1, 20)).otherwise(body).alias("payload"))
    return codecs.decode_msgpack(rows).filter("err is null").select("id", "publisher", F.col("seq").cast("string").alias("seq"), "op", "key")


PATTERN = r"(?<publisher>\w+) (?<op>\w+) (?<key>\S*)(?: (?<value>.*))?"


@query("cod_16_template", "select event_id as id, event_type as publisher, 'set' as op, concat('u', cast(user_id as varchar)) as key, case when event_id % 2 = 0 then 'some text' end as value from events where event_id % 5 <> 0")
def _(spark, d):
    e = F.col("event_id")
    line = F.concat(F.col("event_type"), F.lit(" SET u"), F.col("user_id").cast("string"), F.when(e % 2 == 0, " some text\r\n").otherwise("\n"))
    rows = spark.read.parquet(f"{d}/events.parquet").select(e.alias("id"), F.when(e % 5 == 0, "no-match").otherwise(line).alias("payload"))
    return codecs.decode_template(rows, PATTERN).filter("err is null").select("id", "publisher", "op", "key", "value")


@query("cod_17_line_ends", "select event_id as id, case when event_id % 3 = 2 then 3 else 2 end as n from events")
def _(spark, d):
    made = F.element_at(F.array(*[F.lit(x) for x in ("ab\n", "ab\r\n", "ab\r")]), (F.col("event_id") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.length(F.regexp_replace(made, r"\r?\n\z", "")).alias("n"))


@query("cod_18_raw_kept", RAW + " select id, payload from p where id % 9 = 0")
def _(spark, d):
    return _decoded(spark, d).filter("id % 9 = 0").select("id", "payload")


@query("src_4_pacing", "select event_id, date_diff('microsecond', (select min(ts) from events), ts) // 60 as due_us from events")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return files.paced(rows, "ts", 60.0).select("event_id", "due_us")


@query("src_5_envelope", "select event_id as id, concat('t', cast(event_id % 3 as varchar)) as topic from events")
def _(spark, d):
    e = F.col("event_id")
    text = F.concat(F.lit('{"topic":"t'), (e % 3).cast("string"), F.lit('","ts":1}'))
    rows = spark.read.parquet(f"{d}/events.parquet").select(e.alias("id"), text.alias("payload"))
    return files.envelope(rows).select("id", "topic")


@query("src_7_frames", "select event_id as id, case when event_id % 4 = 1 then '' else 'topic' end as topic, concat('body', cast(event_id as varchar)) as payload from events where event_id % 4 <> 0")
def _(spark, d):
    e = F.col("event_id")
    body = F.concat(F.lit("body"), e.cast("string"))
    frames = F.when(e % 4 == 0, F.array().cast("array<string>")).when(e % 4 == 1, F.array(body)).when(e % 4 == 2, F.array(F.lit("topic"), body)).otherwise(F.array(F.lit("topic"), body, F.lit("rest")))
    return files.split_frames(spark.read.parquet(f"{d}/events.parquet").select(e.alias("id"), frames.alias("frames")))


@query("src_12_gap_signals", "select event_id as arrival, case when event_id % 2 = 0 then 'reconnect' else 'idle_timeout' end as reason from events where event_id % 500 = 3 or event_id % 500 = 4")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").filter("event_id % 500 in (3, 4)")
    return files.signals(rows.select(F.col("event_id").alias("arrival"), F.when(F.col("event_id") % 2 == 0, "reconnect").otherwise("idle_timeout").alias("reason")))


# Perturbations: what each does to the stream, for drills

def _stream(spark: SparkSession, d: str) -> DataFrame:
    return base.stream(spark, d).withColumn("payload", F.concat("key", F.lit("#"), F.col("event_id").cast("string")))


@query("snk_9_dropped_stream", "select event_id from events where event_id % 37 <> 0 and not (event_id between 100 and 120)")
def _(spark, d):
    return faults.drop_range(faults.drop_every(base.stream(spark, d), "event_id", 37), "event_id", 100, 120).select("event_id")


@query("snk_9_dropped_share", "select event_id from events where cast(concat('0x', left(md5(concat('1:', event_id)), 8)) as bigint) % 1000000 >= 100000")
def _(spark, d):
    return faults.drop_share(base.stream(spark, d), "event_id", 0.1).select("event_id")


@query("snk_9_duplicated", sql.STREAM + " select event_id, arrival from st union all select event_id, arrival + 5000 from st where event_id % 50 = 0")
def _(spark, d):
    return faults.duplicate(base.stream(spark, d), "event_id", 50, 5000).select("event_id", "arrival")


@query("snk_9_swapped", sql.STREAM + " select event_id, arrival + case when (event_id // 2) % 7 = 0 then case when event_id % 2 = 0 then 11 else -11 end else 0 end as arrival from st")
def _(spark, d):
    return faults.swap(base.stream(spark, d), "event_id", 7, 10).select("event_id", "arrival")


@query("snk_9_delayed", sql.STREAM + " select event_id, arrival + case when publisher = (select min(publisher) from st) then 70000 else 0 end as arrival from st")
def _(spark, d):
    rows = base.stream(spark, d)
    return faults.delay(rows, rows.agg(F.min("publisher")).scalar(), 70_000).select("event_id", "arrival")


@query("snk_9_partitioned", sql.STREAM + " select event_id from st where not (publisher = (select min(publisher) from st) and arrival between 1000 and 30000)")
def _(spark, d):
    rows = base.stream(spark, d)
    return faults.partition(rows, rows.agg(F.min("publisher")).scalar(), 1000, 30_000).select("event_id")


@query("snk_9_corrupted", sql.STREAM + " select event_id, event_id % 13 = 0 as bad, length(concat(key, '#', cast(event_id as varchar))) + case when event_id % 13 = 0 then 1 else 0 end as n from st")
def _(spark, d):
    rows = faults.corrupt(_stream(spark, d), "event_id", 13)
    return rows.select("event_id", F.col("payload").startswith("\x00").alias("bad"), F.length("payload").cast("long").alias("n"))


@query("snk_9_truncated", sql.STREAM + " select event_id, case when event_id % 11 = 0 then left(concat(key, '#', cast(event_id as varchar)), 4) else concat(key, '#', cast(event_id as varchar)) end as payload from st")
def _(spark, d):
    return faults.truncate(_stream(spark, d), "event_id", 11, 4).select("event_id", "payload")


@query("snk_9_oversized", sql.STREAM + " select event_id, length(concat(key, '#', cast(event_id as varchar))) + case when event_id % 17 = 0 then 3000 else 0 end as n, event_id % 17 = 0 as dropped from st")
def _(spark, d):
    rows = faults.oversize(_stream(spark, d), "event_id", 17, 3000)
    return files.capped(rows, 2000).select("event_id", F.length("payload").cast("long").alias("n"), F.col("oversized").alias("dropped"))


@query("snk_9_skewed", sql.STREAM + " select event_id, date_diff('microsecond', observed_at, published_at + to_microseconds(case when publisher = (select max(publisher) from st) then 90000000 else 0 end)) as ahead_us from st")
def _(spark, d):
    rows = base.stream(spark, d)
    skewed = faults.skew(rows, rows.agg(F.max("publisher")).scalar(), 90_000_000)
    return skewed.select("event_id", F.timestamp_diff("MICROSECOND", F.col("observed_at"), F.col("published_at")).alias("ahead_us"))


RESET = sql.STREAM + " select event_id, epoch{} as epoch, case when late then seq - 499 else seq end as seq from (select *, seq >= 500 and publisher = (select min(publisher) from st) as late from st)"


@query("snk_9_sequence_reset", RESET.format(""))
def _(spark, d):
    rows = base.stream(spark, d)
    return faults.restart(rows, rows.agg(F.min("publisher")).scalar(), 500, False).select("event_id", "epoch", "seq")


@query("snk_9_epoch_bump", RESET.format(" + cast(late as bigint)"))
def _(spark, d):
    rows = base.stream(spark, d)
    return faults.restart(rows, rows.agg(F.min("publisher")).scalar(), 500, True).select("event_id", "epoch", "seq")
