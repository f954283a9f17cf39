"""Secret scans: fixed patterns, and a sliding Shannon entropy over candidate strings.

Everything is a DataFrame expression on one row: no shuffle, no Python on the executors. Positions count code points,
ends are exclusive. A null text is read as the empty text and has no spans; every input row gives one output row,
repeated rows included, and other columns pass through untouched, whatever their names. Empty table: no rows. Very long
text: one row of one task; lists are made in blocks and spans looked up by binary search, so time hardly grows faster than
the text and its spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import renamed


@dataclass(frozen=True)
class CharClass:
    """A class of candidate strings, with the bits of entropy that a window of it must reach."""

    kind: str
    pattern: str
    alphabet: str
    fold_case: bool
    window: int
    bits: float


# The base patterns, in their listed order.
BASE = (
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)
VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
MIN_CHARS = {"assign": 6, "access": 20, "hex": 24}

DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])", "0123456789abcdef", True, 20, 3.0),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", DIGITS + LETTERS + LETTERS.upper() + "+/_=-", False, 24, 4.0),
)
#: Candidates that are no secrets: UUIDs, plain numbers, strings without a digit (words and identifiers), placeholders.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[0-9]+$",
    r"^[^0-9]+$",
    r"(?i)example|placeholder|your[_-]?(?:api[_-]?)?key|x{6,}",
)
BLOCK, CHUNK = 256, 4096


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def matches(text: str, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches of a pattern that matches no empty string.

    The pieces between matches come from split(); running sums of the lengths give positions. Sums run over blocks of
    matches, so that a text with very many of them is not copied once for each.
    """
    p = _quoted(pattern)
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    step = """(a, x) -> named_struct('at', a.at + x.gap + length(x.value), 'found', concat(a.found, array(named_struct(
        'start', a.at + x.gap, 'end', a.at + x.gap + length(x.value), 'value', x.value))))"""
    zero = f"cast(array() as {kind})"
    inner = f"aggregate(slice(zipped, b * {BLOCK} + 1, {BLOCK}), named_struct('at', s.at, 'found', {zero}), {step})"
    outer = f"""aggregate(sequence(0, (size(zipped) - 1) div {BLOCK}), named_struct('at', 0L, 'found', {zero}),
        (s, b) -> transform(array({inner}), i -> named_struct('at', i.at, 'found', concat(s.found, i.found)))[0], s -> s.found)"""
    # A lambda over a one-element array names an intermediate value.
    zipped = f"""zip_with(slice(split({text}, {p}, -1), 1, size(m)), m, (g, v) -> named_struct('gap', length(g), 'value', v))"""
    return F.expr(f"""transform(array(regexp_extract_all({text}, {p}, 0)), m -> if(size(m) = 0, {zero},
        transform(array({zipped}), zipped -> {outer})[0]))[0]""")


def entropy_extent(value: str, c: CharClass) -> str:
    """SQL for struct<lo, hi>: from the first to behind the last window of the candidate whose entropy reaches c.bits.

    One pass with counts per character: a step adds the character that enters the window and takes off the one that
    leaves it; the sum of n*log2(n) follows from the two counts that changed. lo is null if no window reaches the limit.
    """
    w, n = c.window, len(c.alphabet)
    logs = "array(" + ", ".join(f"{k * math.log2(k) if k else 0.0!r}D" for k in range(w + 2)) + ")"
    folded = f"lower({value})" if c.fold_case else value
    enter = f"""transform(array(named_struct('a', instr('{c.alphabet}', ch[i - 1]) - 1,
        'o', if(i > {w}, instr('{c.alphabet}', ch[i - 1 - {w}]) - 1, -1))), z ->
        transform(array(transform(s.counts, (x, k) -> x - int(k = z.o))), less -> named_struct(
            'counts', transform(less, (x, k) -> x + int(k = z.a)),
            'sum', s.sum + if(z.o >= 0, logs[less[z.o]] - logs[less[z.o] + 1], 0D) + logs[less[z.a] + 1] - logs[less[z.a]]))[0])[0]"""
    step = f"""transform(array({enter}), t -> named_struct('counts', t.counts, 'sum', t.sum,
        'lo', if(s.lo is null and i >= {w} and {math.log2(w)!r}D - t.sum / {w} >= {c.bits!r}D, i - {w}, s.lo),
        'hi', if(i >= {w} and {math.log2(w)!r}D - t.sum / {w} >= {c.bits!r}D, i, s.hi)))[0]"""
    return f"""transform(array(named_struct('ch', split({folded}, ''), 'logs', {logs})), y -> transform(array(y.ch), ch -> transform(array(y.logs), logs ->
        aggregate(sequence(1, length({value})), named_struct('counts', array_repeat(0, {n}), 'sum', 0D, 'lo', cast(null as int), 'hi', cast(null as int)),
        (s, i) -> {step}, s -> named_struct('lo', s.lo, 'hi', s.hi)))[0])[0])[0]"""


def _inside(spans: str, n: str) -> str:
    """SQL for whether span n lies in one of the spans, which are sorted and do not overlap: only the last one that begins no later than n can hold it, found by binary search."""
    mid = "int((s.lo + s.hi) div 2)"
    step = f"if(s.lo < s.hi, if({spans}[{mid}].start <= {n}.start, named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid})), s)"
    place = f"aggregate(sequence(1, int(ceil(log2(size({spans}) + 1))) + 1), named_struct('lo', 0, 'hi', size({spans})), (s, i) -> {step}, s -> s.lo)"
    return f"coalesce(get({spans}, {place} - 1).end >= {n}.end, false)"


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with one more column: array<struct<start, ord, end, kind, value>>, sorted by start, then kind as listed."""
    kinds = [k for k, _ in BASE] + [c.kind for c in CLASSES]
    docs, back = renamed(docs.drop(out))
    df = docs.withColumn("__t", F.coalesce(F.col(back.here(text)), F.lit("")))
    for kind, pattern in BASE:
        # A match that is too short fails; it has used up its text all the same. hex can ask for the length at once, as its run is maximal.
        long = pattern.replace("]+", "]{24,}") if kind == "hex" else pattern
        size = f"length(regexp_extract(v.value, {_quoted(VALUE)}, 1))" if kind == "assign" else "length(v.value)"
        df = df.withColumn(f"__{kind}", matches("__t", long)).withColumn(
            f"__{kind}",
            F.expr(f"""transform(filter(__{kind}, v -> {size} >= {MIN_CHARS[kind]}),
                v -> named_struct('start', v.start, 'ord', {kinds.index(kind)}, 'end', v.end, 'kind', '{kind}', 'value', v.value))"""),
        )
    df = df.withColumn("__base", F.concat(*[F.col(f"__{k}") for k, _ in BASE]))
    for c in CLASSES:
        allowed = " or ".join(f"v.value rlike {_quoted(p)}" for p in ALLOWED)
        df = df.withColumn(f"__{c.kind}", matches("__t", c.pattern)).withColumn(
            f"__{c.kind}",
            F.expr(f"""filter(transform(filter(__{c.kind}, v -> not ({allowed})), v -> transform(array({entropy_extent("v.value", c)}), e ->
                named_struct('start', v.start + e.lo, 'ord', {kinds.index(c.kind)}, 'end', v.start + e.hi, 'kind', '{c.kind}',
                'value', substring(v.value, e.lo + 1, e.hi - e.lo)))[0]),
                n -> n.start is not null and not ({" or ".join(_inside(f"__{k}", "n") for k, _ in BASE)}))"""),
        )
    hex_kind, other = (f"__{c.kind}" for c in CLASSES)
    df = df.withColumn(other, F.expr(f"filter({other}, n -> not {_inside(hex_kind, 'n')})"))
    return back(df, F.array_sort(F.concat("__base", hex_kind, other)).alias(out))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of the text replaced by a mark; spans that touch or overlap become one. Texts without spans stay, nulls too."""
    kind = "array<struct<start:bigint,end:bigint>>"
    none = f"cast(array() as {kind})"
    step = """(a, x) -> if(x.start <= a.hi, named_struct('lo', a.lo, 'hi', greatest(a.hi, x.end), 'done', a.done),
        named_struct('lo', x.start, 'hi', x.end, 'done', if(a.hi < 0, a.done, concat(a.done, array(named_struct('start', a.lo, 'end', a.hi))))))"""
    # As in matches(): a block's list is short, and only whole blocks are put behind what is there.
    inner = f"aggregate(slice(s_, b * {BLOCK} + 1, {BLOCK}), named_struct('lo', o.lo, 'hi', o.hi, 'done', {none}), {step})"
    merged = f"""aggregate(sequence(0, (size(s_) - 1) div {BLOCK}), named_struct('lo', -1L, 'hi', -1L, 'done', {none}),
        (o, b) -> transform(array({inner}), i -> named_struct('lo', i.lo, 'hi', i.hi, 'done', concat(o.done, i.done)))[0],
        o -> concat(o.done, array(named_struct('start', o.lo, 'end', o.hi))))"""
    # What stays is cut from chunks, as finding a place in a string takes time in proportion to it.
    chunks = f"regexp_extract_all(t_, '(?s).{{1,{CHUNK}}}', 0)"
    part = f"""if(x.a >= x.b, '', if(x.a div {CHUNK} = (x.b - 1) div {CHUNK}, substring(c[int(x.a div {CHUNK})], int(x.a % {CHUNK}) + 1, int(x.b - x.a)),
        concat(substring(c[int(x.a div {CHUNK})], int(x.a % {CHUNK}) + 1, {CHUNK}), array_join(slice(c, int(x.a div {CHUNK}) + 2, int((x.b - 1) div {CHUNK} - x.a div {CHUNK} - 1)), ''),
            substring(c[int((x.b - 1) div {CHUNK})], 1, int((x.b - 1) % {CHUNK}) + 1))))"""
    places = "transform(sequence(0, size(m)), i -> named_struct('a', if(i = 0, 0L, m[i - 1].end), 'b', if(i = size(m), bigint(length(t_)), m[i].start)))"
    kept = f"""transform(array({merged}), m -> transform(array({chunks}), c -> array_join(transform({places}, x -> {part}), '{mark.replace("'", "\\'")}'))[0])[0]"""
    docs, back = renamed(docs)
    t = back.here(text)
    df = scan(docs.withColumn("t_", F.col(t)), "t_", "s_")
    return back(df.withColumn(t, F.expr(f"if(size(s_) = 0, t_, {kept})")))
