"""Column helpers: rendering, redaction, durations, saturating sums, listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG, MIN_LONG = (1 << 63) - 1, -(1 << 63)
#: Code points that a rendered scalar shows, members that a rendered set shows.
SHOWN_BYTES, SHOWN_MEMBERS = 64, 8


def normalise_op(op: Column) -> Column:
    """An operation name without case, surrounding spaces, hyphens and underscores."""
    return F.lower(F.regexp_replace(F.trim(op), "[_-]", ""))


def render_value(kind: Column, scalar: Column, members: Column, counter: Column) -> Column:
    """absent, scalar("..."), set(n)[a b ...] or counter(n). Bytes that are no UTF-8 show as hex."""
    text = F.when(F.is_valid_utf8(scalar), F.concat(F.lit('scalar("'), F.left(scalar, F.lit(SHOWN_BYTES)), F.when(F.octet_length(scalar) > SHOWN_BYTES, "...").otherwise(""), F.lit('")')))
    text = text.otherwise(F.concat(F.lit("scalar(0x"), F.lower(F.hex(F.encode(scalar, "UTF-8"))), F.lit(")")))
    shown = F.array_join(F.slice(F.array_sort(members), 1, SHOWN_MEMBERS), " ")
    more = F.when(F.size(members) > SHOWN_MEMBERS, " ...").otherwise("")
    sets = F.concat(F.lit("set("), F.size(members).cast("string"), F.lit(")["), shown, more, F.lit("]"))
    return F.when(kind == "scalar", text).when((kind == "set") & (F.size(members) > 0), sets).when(kind == "counter", F.concat(F.lit("counter("), counter.cast("string"), F.lit(")"))).otherwise("absent")


def key_display(key: Column) -> Column:
    """A key as it is, or hex: and its bytes if it holds control characters or no UTF-8."""
    return F.when(key.rlike(r"[\x00-\x1f\x7f]") | ~F.is_valid_utf8(key), F.concat(F.lit("hex:"), F.lower(F.hex(F.encode(key, "UTF-8"))))).otherwise(key)


def redact(key: Column) -> Column:
    """sha256: and the first eight bytes of the digest."""
    return F.concat(F.lit("sha256:"), F.left(F.sha2(key, 256), F.lit(16)))


def compact_duration(micros: Column) -> Column:
    """A duration in the largest unit that leaves a number of one or more: us, ms, s, m, h."""
    out = F.concat(micros.cast("string"), F.lit("us"))
    for size, unit in ((1_000, "ms"), (1_000_000, "s"), (60_000_000, "m"), (3_600_000_000, "h")):
        out = F.when(F.abs(micros) >= size, F.concat((micros / size).cast("decimal(20,1)").cast("string"), F.lit(unit))).otherwise(out)
    return out


def parse_duration(text: Column) -> Column:
    """Microseconds of a duration such as 1h30m, -1.5s or 250ms, or of a bare number of seconds; null if it is neither."""
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    units = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1, "µs": 1, "ns": 0.001}
    numbers = F.regexp_extract_all(text, F.lit(r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|ms|s|m|h)"), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|ms|s|m|h)"), F.lit(2))
    factor = F.create_map(*[F.lit(x) for k, v in units.items() for x in (k, float(v))])
    total = F.aggregate(F.zip_with(numbers, names, lambda n, u: n.cast("double") * F.element_at(factor, u)), F.lit(0.0), lambda a, x: a + x)
    written = text.rlike(r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|ms|s|m|h))+$")
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.when(written, (sign * F.floor(total)).cast("long")).when(plain, (text.cast("double") * 1_000_000).cast("long"))


def saturating(total: Column) -> Column:
    """A decimal sum as a bigint that stops at either end instead of failing."""
    return F.greatest(F.least(total, F.lit(MAX_LONG).cast("decimal(38,0)")), F.lit(MIN_LONG).cast("decimal(38,0)")).cast("long")


def pressure_percent(used: Column, limit: Column) -> Column:
    """Memory in use as a whole percentage; null without a limit."""
    return F.when(limit > 0, F.floor(used * 100 / limit).cast("long"))


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for size, unit in ((1 << 10, "KiB"), (1 << 20, "MiB"), (1 << 30, "GiB")):
        out = F.when(n >= size, F.concat((n / size).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded half away from zero; 1 if there is no whole."""
    return F.when(whole == 0, 1.0).otherwise(F.round(part / whole, digits))


def listing(members: Column, n: int) -> Column:
    """The first n members in order, joined by commas."""
    return F.array_join(F.slice(F.array_sort(members), 1, n), ",")


def interval_listing(intervals: Column, n: int = 3) -> Column:
    """[a,b] [c,d] ... and how many more, from array<struct<lo, hi>>."""
    shown = F.array_join(F.transform(F.slice(intervals, 1, n), lambda x: F.concat(F.lit("["), x["lo"].cast("string"), F.lit(","), x["hi"].cast("string"), F.lit("]"))), " ")
    return F.concat(shown, F.when(F.size(intervals) > n, F.concat(F.lit(" and "), (F.size(intervals) - n).cast("string"), F.lit(" more"))).otherwise(""))


def glob_to_regex(glob: str, path: bool = True) -> str | None:
    """A regular expression for a shell pattern; with path, * and ? stop at a slash. None if brackets do not match."""
    out, i = "", 0
    star, one = ("[^/]*", "[^/]") if path else (".*", ".")
    while i < len(glob):
        c = glob[i]
        if c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += "\\" + glob[i] if not glob[i].isalnum() else glob[i]
        else:
            out += star if c == "*" else one if c == "?" else c if c.isalnum() or c in "_ -:/" else "\\" + c
        i += 1
    return f"(?s)^{out}$"


def valid_glob(glob: str) -> bool:
    return bool(glob) and glob_to_regex(glob) is not None


def matches_glob(value: Column, glob: str, path: bool = True) -> Column:
    pattern = glob_to_regex(glob, path)
    return F.lit(False) if pattern is None else value.rlike(pattern)


def key_template(template: str, columns: dict[str, Column | None]) -> Column | None:
    """A template such as user:{{.Key}} as a column; unknown fields are an error. Without columns (all None) the template is only checked."""
    import re

    parts: list[Column] = []
    check = all(c is None for c in columns.values())
    for literal, name in re.findall(r"([^{]+|\{(?!\{))|\{\{\s*\.(\w+)\s*\}\}", template):
        if name and name not in columns:
            raise ValueError(f"unknown field {name} in the key template")
        if not check:
            parts.append(columns[name].cast("string") if name else F.lit(literal))
    return None if check else F.concat(*parts) if parts else F.lit("")
