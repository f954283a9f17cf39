"""Decoders: payloads to event columns. A payload that cannot be decoded gives a row with an error, never an exception."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import normalise_op, parse_duration
from tidemark.operators.validate import MAX_KEY_BYTES, MAX_PAYLOAD_BYTES, OPS
from tidemark.shipping import ship

FIELDS = ("publisher", "epoch", "seq", "ts", "op", "key", "member", "value", "ttl", "delta")
EVENT = "publisher string, epoch decimal(20,0), seq decimal(20,0), published_at timestamp, op string, key string, member string, value string, ttl bigint, delta bigint"
MAX_DEPTH, MAX_UINT = 32, 18446744073709551615


def unsigned(text: Column) -> Column:
    """Digits as a number up to 2^64 - 1; absent is 0; null if it is neither."""
    n = F.when(text.rlike(r"^[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))
    return F.when(text.isNull(), F.lit(0).cast("decimal(20,0)")).when(n <= F.lit(str(MAX_UINT)).cast("decimal(20,0)"), n)


def timestamp(text: Column) -> Column:
    """RFC 3339 with upper-case T and Z, or a number of seconds, milliseconds or nanoseconds by its size; 0 is unset, and a number beyond 64 bits is none."""
    n = F.when(text.rlike(r"^-?[0-9]{1,19}$"), text.try_cast("long"))
    # Not by abs(), which the smallest of all numbers has none of.
    within = lambda x: n.between(1 - x, x - 1)
    at = F.when(n == 0, F.lit(None)).when(within(100_000_000_000), F.timestamp_seconds(n)).when(within(100_000_000_000_000), F.timestamp_millis(n)).otherwise(F.timestamp_micros(F.floor(n.cast("decimal(20,0)") / 1000).cast("long")))
    written = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"), text.try_cast("timestamp"))
    return F.when(n.isNotNull(), at).otherwise(written)


def operation(text: Column, foreign: Mapping[str, str], trim: bool) -> Column:
    """The operation's own name, by the foreign table first, then by its name without case, hyphens and underscores; null if unknown."""
    own = F.create_map(*[F.lit(x) for op in OPS for x in (op.replace("_", ""), op)])
    named = F.element_at(own, normalise_op(text) if trim else F.lower(F.regexp_replace(text, "[_-]", "")))
    if not foreign:
        return named
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in foreign.items() for x in kv]), text), named)


def _event(rows: DataFrame, text: Mapping[str, Column], broken: Column, foreign: Mapping[str, str], trim: bool) -> DataFrame:
    """rows with event columns and err, from the text of each field."""
    t = {n: text.get(n, F.lit(None).cast("string")) for n in FIELDS}
    made = {
        "publisher": t["publisher"], "epoch": unsigned(t["epoch"]), "seq": unsigned(t["seq"]), "published_at": timestamp(t["ts"]), "op": operation(t["op"], foreign, trim),
        "key": t["key"], "member": t["member"], "value": t["value"], "ttl": parse_duration(t["ttl"]), "delta": t["delta"].try_cast("long"),
    }
    bad = F.lit(False)
    for name, raw in (("epoch", "epoch"), ("seq", "seq"), ("ttl", "ttl"), ("delta", "delta")):
        bad = bad | (t[raw].isNotNull() & made[name].isNull())
    bad = bad | (t["ts"].isNotNull() & (t["ts"] != "0") & made["published_at"].isNull()) | F.coalesce(made["ttl"] < 0, F.lit(False))
    long = (F.octet_length(t["key"]) > MAX_KEY_BYTES) | (F.octet_length(t["member"]) > MAX_KEY_BYTES)
    err = broken
    err = F.coalesce(err, F.when(F.coalesce(long, F.lit(False)), "too_large").when(bad, "malformed").when(t["op"].isNull(), "missing_field:op").when(made["op"].isNull(), "unknown_op"))
    rows = rows.withColumn("err", err)
    return rows.withColumns({n: F.when(F.col("err").isNull(), c) for n, c in made.items()})


def decode_json(raw: DataFrame, names: Mapping[str, str] | None = None, foreign: Mapping[str, str] | None = None, payload: str = "payload") -> DataFrame:
    """raw (payload string) with event columns and err. names: event field -> field in the payload; several may share one.

    The last of repeated fields counts. Anything but white space behind the object, nesting beyond 32 and payloads over
    1 MiB are errors. A payload without a field has its default.
    """
    wire = {f: (names or {}).get(f, f) for f in FIELDS}
    schema = ", ".join(f"`{w}` string" for w in sorted(set(wire.values())))
    p = F.col(payload)
    # Strings are taken out first, so that brackets in them do not count. Once, as a column: all checks below read it.
    raw = raw.withColumn("__bare", F.regexp_replace(p, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""'))
    bare = F.col("__bare")
    shape = F.regexp_replace(bare, r"[^\[\]{}]", "")
    deepest = F.aggregate(F.split(shape, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, x: F.struct((a["d"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)).alias("d"), F.greatest(a["m"], a["d"] + F.when(x.isin("{", "["), 1).otherwise(0)).alias("m")), lambda a: a["m"])
    # Brackets are only counted where there are enough of them.
    deep = F.when(F.length(shape) > MAX_DEPTH, deepest > MAX_DEPTH).otherwise(False)
    # A second object, or more text, behind the first one's end.
    trailing = bare.rlike(r"(?s)^\s*\{") & ~bare.rlike(r"(?s)^\s*\{.*\}\s*$")
    # An object or array right behind the end of another is nowhere allowed within one.
    several = bare.rlike(r"[}\]]\s*[{\[]")
    rows = raw.withColumn("__j", F.from_json(p, f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    broken = (
        F.when(F.octet_length(p) > MAX_PAYLOAD_BYTES, "too_large").when(p.isNull() | ~bare.rlike(r"(?s)^\s*\{") | F.col("__j.__corrupt").isNotNull() | trailing, "malformed")
        .when(deep, "too_large").when(several, "malformed")
    )
    text = {f: F.col(f"__j.`{w}`") for f, w in wire.items()}
    return _event(rows, text, broken, foreign or {}, False).drop("__j", "__bare")


def decode_template(raw: DataFrame, pattern: str, foreign: Mapping[str, str] | None = None, payload: str = "payload") -> DataFrame:
    """raw with event columns and err, by a regular expression whose named groups are fields. One line end is cut off first."""
    import re

    groups = re.compile(pattern.replace("(?<", "(?P<") if "(?P<" not in pattern else pattern).groupindex
    if "op" not in groups:
        raise ValueError("the pattern needs a group named op")
    if re.fullmatch(pattern.replace("(?<", "(?P<") if "(?P<" not in pattern else pattern, ""):
        raise ValueError("the pattern must not match the empty line")
    java = "^(?:" + pattern.replace("(?P<", "(?<") + ")$"
    line = F.regexp_replace(F.col(payload), r"\r?\n\z", "")
    rows = raw.withColumn("__l", line)
    text = {f: F.nullif(F.regexp_extract("__l", java, i), F.lit("")) for f, i in groups.items() if f in FIELDS}
    return _event(rows, text, F.when(F.col("__l").isNull() | ~F.col("__l").rlike(java), "malformed"), foreign or {}, True).drop("__l")


class Unpacked:
    """A reader of msgpack values; anything unexpected raises ValueError."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int | float:
        return struct.unpack(">" + kind, self.take(struct.calcsize(kind)))[0]

    def value(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise ValueError("deep")
        b = self.take(1)[0]
        if b < 0x80:
            return b
        if b >= 0xE0:
            return b - 256
        if b >= 0xA0 and b < 0xC0:
            return self.take(b & 31).decode("utf-8", "replace")
        if b >= 0x90 and b < 0xA0 or b in (0xDC, 0xDD):
            return [self.value(depth + 1) for _ in range(b & 15 if b < 0xA0 else self.number("H" if b == 0xDC else "I"))]
        if b < 0x90 or b in (0xDE, 0xDF):
            return {self.value(depth + 1): self.value(depth + 1) for _ in range(b & 15 if b < 0x90 else self.number("H" if b == 0xDE else "I"))}
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if b in (0xC4, 0xC5, 0xC6):
            return self.take(self.number("BHI"[b - 0xC4]))
        if b in (0xCA, 0xCB):
            return self.number("fd"[b - 0xCA])
        if 0xCC <= b <= 0xCF:
            return self.number("BHIQ"[b - 0xCC])
        if 0xD0 <= b <= 0xD3:
            return self.number("bhiq"[b - 0xD0])
        if b in (0xD9, 0xDA, 0xDB):
            return self.take(self.number("BHI"[b - 0xD9])).decode("utf-8", "replace")
        raise ValueError("kind")


def written(x) -> str | None:
    """A field's text; numbers that ought to be whole stay so, floats keep their point."""
    if x is None:
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    return x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x)


def decode_msgpack(raw: DataFrame, names: Mapping[str, str] | None = None, foreign: Mapping[str, str] | None = None, payload: str = "payload") -> DataFrame:
    """raw (payload binary) with event columns and err. Bytes become texts in Arrow batches; the rest is shared with the other decoders."""
    ship(raw.sparkSession)
    wire = {f: (names or {}).get(f, f) for f in FIELDS}
    kept = raw.columns
    from pyspark.sql.types import StructType

    kind = StructType(raw.schema.fields + StructType.fromDDL("__e string, " + ", ".join(f"__{f} string" for f in FIELDS)).fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors, found = [], {f: [] for f in FIELDS}
            for data in b.column(payload).to_pylist():
                error, x = None, {}
                if data is None:
                    error = "malformed"
                elif len(data) > MAX_PAYLOAD_BYTES:
                    error = "too_large"
                else:
                    try:
                        r = Unpacked(data)
                        x = r.value()
                        if not isinstance(x, dict) or r.at != len(data):
                            raise ValueError("shape")
                    except (ValueError, TypeError, OverflowError, RecursionError):
                        error, x = "malformed", {}
                errors.append(error)
                for f, w in wire.items():
                    found[f].append(written(x.get(w)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(errors, "string"), *(pa.array(v, "string") for v in found.values())], names=[*kept, "__e", *(f"__{f}" for f in FIELDS)])

    rows = raw.mapInArrow(work, kind)
    return _event(rows, {f: F.col(f"__{f}") for f in FIELDS}, F.col("__e"), foreign or {}, True).drop("__e", *(f"__{f}" for f in FIELDS))
