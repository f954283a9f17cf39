import json
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import codecs
from tidemark.plans import registry

MALFORMED = ["", " ", "{", "[1]", "null", '{"op":"set"} {}', '{"op":"set"}x', '{"op":"set","seq":1.5,"publisher":"p"}', '{"op":"set","seq":-1}', '{"op":"set","ttl":-3}', '{"op":"set","ts":"2024-01-01t00:00:00z"}', '{"op":"se', "\x00{}"]


def decode(spark, texts, **kw):
    return codecs.decode_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, payload string"), **kw).orderBy("i").collect()


def test_malformed_payloads_are_errors(spark):
    assert [r.err for r in decode(spark, MALFORMED)] == ["malformed"] * len(MALFORMED)


def test_fields(spark):
    r = decode(spark, ['{"publisher":"p\\u00e9","epoch":"7","seq":18446744073709551615,"ts":"2024-05-06T07:08:09.123456789Z","op":"Snap_shot-begin","key":"","x":{"y":"}{"},"ttl":"1h1.5s","delta":-9}'])[0]
    assert (r.err, r.publisher, int(r.epoch), int(r.seq), r.op, r.key, r.ttl, r.delta) == (None, "pé", 7, 18446744073709551615, "snapshot_begin", "", 3601500000, -9)
    assert r.published_at.microsecond == 123456


def test_times_at_the_ends_of_64_bits(spark):
    numbers = [str(-(2**63)), str(2**63 - 1), str(2**63), "9" * 19, "9" * 25, "0", "1700000000"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i long, text string")
    got = rows.select("i", F.unix_micros(codecs.timestamp(F.col("text"))).alias("us")).orderBy("i").collect()
    assert [r.us for r in got] == [-(2**63) // 1000, (2**63 - 1) // 1000, None, None, None, None, 1_700_000_000_000_000]


def test_times_of_large_ids_are_no_error(spark, tmp_path):
    ids = [0, 46, 47, 209_715, 209_716, 3_000_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: r.micros for r in registry.queries()["cod_10_unix_units"](spark, str(tmp_path)).collect()}
    assert got == {0: -1, 46: 46**3 * 10**9, 47: 47**3 * 10**9, 209_715: 209_715**3, 209_716: -1, 3_000_000_000: -1}


def test_strings_are_taken_out_once(spark):
    text = r'{"publisher":"a\"[{\\","op":"delete","key":"%s"}'
    long = [text % ("k" * n) for n in (4096, 4097)] + [text % "[" * 4096, text % ("\\\\" * 2000), '{"op":"set","key":"' + "\\" * 3]
    assert [r.err for r in decode(spark, long)] == [None, "too_large", "malformed", None, "malformed"]
    df = codecs.decode_json(spark.createDataFrame([("x",)], "payload string")).select("err")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(payload") == 1


def test_foreign_names(spark):
    text = json.dumps({"replica": "r1", "event_id": 5, "event_type": "BlockStored", "hash": "h"})
    r = decode(spark, [text], names={"publisher": "replica", "member": "replica", "seq": "event_id", "op": "event_type", "key": "hash"}, foreign={"BlockStored": "add"})[0]
    assert (r.publisher, r.member, int(r.seq), r.op, r.key, r.err) == ("r1", "r1", 5, "add", "h", None)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60) | st.from_regex(r'\{"(op|seq|publisher)":("[a-z]{0,5}"|[0-9]{1,25}|\[\])\}?', fullmatch=True), min_size=1, max_size=40))
def test_any_text_gives_a_row(spark, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert len(decode(spark, texts)) == len(texts)


def test_templates(spark):
    with pytest.raises(ValueError):
        codecs.decode_template(spark.createDataFrame([("x",)], "payload string"), r"(?<key>\w+)")
    with pytest.raises(ValueError):
        codecs.decode_template(spark.createDataFrame([("x",)], "payload string"), r"(?<op>\w*)")


def pack(x):
    if isinstance(x, str):
        b = x.encode()
        return bytes([0xA0 | len(b)]) + b if len(b) < 32 else b"\xd9" + bytes([len(b)]) + b
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, int):
        return b"\xcf" + struct.pack(">Q", x) if x >= 0 else b"\xd3" + struct.pack(">q", x)
    return bytes([0x80 | len(x)]) + b"".join(pack(k) + pack(v) for k, v in x.items())


def test_msgpack(spark):
    good = pack({"publisher": "p", "op": "incr", "seq": 2**64 - 1, "delta": -4, "key": "k" * 40})
    rows = [good, good + b"\x00", good[:-1], b"", b"\xc1", pack({"publisher": "p", "op": "incr", "seq": 1.0}), None]
    got = codecs.decode_msgpack(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i long, payload binary")).orderBy("i").collect()
    assert [r.err for r in got] == [None] + ["malformed"] * 6
    assert (int(got[0].seq), got[0].delta, got[0].key) == (2**64 - 1, -4, "k" * 40)
