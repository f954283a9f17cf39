"""Document fingerprints by consistent weighted sampling.

A text is the weighted set of its words (split at white space, lower-cased), a word's weight being how often it occurs.
For each of SAMPLES hash functions a word draws r and c from Gamma(2, 1) and b from [0, 1); with weight w,
t = floor(ln w / r + b), and the word with the least ln c - r * (t - b + 1) is sampled as (word, t). Two texts agree in a
sample with a probability equal to their generalised Jaccard similarity J, sum of minima over sum of maxima of weights, but
for the grain of the draws: r and c come from tables of QUANTILES quantiles, indexed by independent bits of one hash, and b
has 24 bits. A likeness comes in steps of 1 / SAMPLES with a standard error of sqrt(J * (1 - J) / SAMPLES), 0.09 at most.

Only DataFrame operations. Texts are dealt once, by ranges of the key, so that a document and its successor meet; word
counts and samples are then aggregated where they are. Each bucket of the ranges also gets the first document of the
next one. Buckets come from quantiles of the key, so no source or group of copies shares one; there are
BUCKETS_PER_PARTITION for each of spark.sql.shuffle.partitions, which has to be set for the size of the input.

Null text: read as the empty text, whose fingerprint is the empty string; two empty fingerprints are alike (1), an empty
and another are not (0). Null key: sorts first. Repeated keys: in the order of the texts' hashes. Keys may be numbers or
texts. One document: it is its own successor. Empty table: no rows. Very long text: dealt once as one row; its words are
counted as rows. Other columns pass through fingerprint(), whatever their names.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, free_name, renamed

SAMPLES, QUANTILES, BUCKETS_PER_PARTITION = 32, 1024, 8


def gamma2_quantile(p: float) -> float:
    """Quantile of Gamma(2, 1), whose distribution function is 1 - (1 + x) * exp(-x)."""
    lo, hi = 0.0, 60.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - (1 + mid) * math.exp(-mid) < p else (lo, mid)
    return lo


def _tables() -> tuple[str, str]:
    values = [gamma2_quantile((k + 0.5) / QUANTILES) for k in range(QUANTILES)]
    as_array = lambda xs: "cast(split('" + ",".join(f"{x:.9g}" for x in xs) + "', ',') as array<double>)"
    return as_array(values), as_array([math.log(x) for x in values])


def samples(term: str, log_weight: str) -> list[Column]:
    """SAMPLES bigints for a word's hash and log weight: the least one wins; the low 32 bits stand for (word, t)."""
    r_table, c_table = _tables()
    mask = QUANTILES - 1
    out = []
    for i in range(SAMPLES):
        x = f"xxhash64({term}, {i})"
        r = f"get({r_table}, int({x} & {mask}))"
        c = f"get({c_table}, int(shiftright({x}, 12) & {mask}))"
        b = f"(shiftrightunsigned({x}, 40) / 16777216D)"
        t = f"floor({log_weight} / {r} + {b})"
        rank = f"bigint(({c} - {r} * ({t} - {b} + 1D) + 64D) * 16777216D)"
        out.append(F.expr(f"shiftleft({rank}, 32) | (xxhash64({term}, {t}, {i}) & 4294967295)"))
    return out


def _sketch(words: DataFrame, by: list[str]) -> DataFrame:
    """by plus sig (array of SAMPLES bigints; null if there is no word) from rows of by and term (null: no word)."""
    counted = words.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n")).withColumn("lw", F.log(F.col("n").cast("double")))
    mins = [F.min(s).alias(f"s{i}") for i, s in enumerate(samples("term", "lw"))]
    low = F.array(*[F.col(f"s{i}").bitwiseAND(F.lit(4294967295)) for i in range(SAMPLES)])
    return counted.groupBy(*by).agg(F.count("term").alias("terms"), *mins).select(*by, F.when(F.col("terms") > 0, low).alias("sig"))


def _words(text: str) -> Column:
    """The words of a text; the empty text has one null word."""
    blank = "".join(f"\\u{ord(c):04x}" for c in SPACES)
    return F.expr(f"explode(transform(split(trim(BOTH '{blank}' FROM lower({text})), r'[{blank}]+'), w -> if(w = '', null, xxhash64(w))))")


def written(sig: Column) -> Column:
    return F.when(sig.isNull(), "").otherwise(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(SAMPLES)))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs plus the fingerprint of each text, by one shuffle of word hashes; for texts that need no successor."""
    docs, back = renamed(docs)
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    words = rows.select("__row", F.coalesce(F.col(back.here(text)), F.lit("")).alias("t")).select("__row", _words("t").alias("term"))
    return back(rows.join(_sketch(words, ["__row"]), "__row"), written(F.col("sig")).alias(out))


def bucket_of(key: str, bounds: list) -> Column:
    """How many of the sorted bounds are at most the key, by binary search; null: 0."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    array = f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)"
    search = f"""aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(bounds)}), (s, i) -> if(s.lo < s.hi,
        if(get({array}, (s.lo + s.hi) div 2) <= {key}, named_struct('lo', int((s.lo + s.hi) div 2 + 1), 'hi', s.hi), named_struct('lo', s.lo, 'hi', int((s.lo + s.hi) div 2))), s), s -> s.lo)"""
    return F.expr(f"if({key} is null, 0, {search})")


def order_number(docs: DataFrame, key: str) -> Column:
    """A bigint that grows with the key: itself, its whole part, or the seven bytes of a text behind what all begin with."""
    kind = docs.schema[key].dataType.typeName()
    if kind in ("long", "integer", "short", "byte"):
        return F.col(key).cast("long")
    if kind != "string":
        return F.floor(F.col(key).cast("double")).cast("long")
    ends = docs.agg(F.encode(F.min(key), "UTF-8").alias("lo"), F.encode(F.max(key), "UTF-8").alias("hi")).first()
    same = len(os.path.commonprefix([bytes(ends.lo or b""), bytes(ends.hi or b"")]))
    digits = F.rpad(F.substring(F.hex(F.encode(key, "UTF-8")), 2 * same + 1, 14), 14, "0")
    return F.conv(digits, 16, 10).cast("long")


def with_successor(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, t, bucket, row, guest, next: each document with its successor's text; guests are only there as successors."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
    base = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"), order_number(docs, key).alias("o"))
    cuts = base.agg(F.percentile_approx("o", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    base = base.withColumn("bucket", bucket_of("o", sorted(set(cuts)))).drop("o")
    # One row for each bucket, n at most.
    firsts = base.groupBy("bucket").agg(F.min(F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("first"))).alias("m")).select("bucket", "m.first")
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn("before", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(whole)))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    other = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    dealt = base.join(F.broadcast(firsts), "bucket").select(key, "t", F.explode(F.when(F.col(key).eqNullSafe(F.col("first")), F.array(own, other)).otherwise(F.array(own))).alias("d")).select(key, "t", "d.*")
    w = Window.partitionBy("bucket").orderBy("guest", F.col(key).asc_nulls_first(), F.xxhash64("t"))
    return dealt.withColumn("next", F.lead("t").over(w)).withColumn("row", F.row_number().over(w))


def with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points replaced by the first as many of the next document's. A key that is
    called like another column of the result is called <name>_key there.
    """
    name = free_name(key, ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
    docs, key, text = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__key", "__text"
    rows = with_successor(docs, key, text)
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.expr("substring(t, 1, int(length(t) - length(t) div 2))"), F.substring("next", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    facts = rows.filter("not guest").select("bucket", "row", key, F.length("t").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    both = rows.select("bucket", "row", F.explode(F.when(F.col("guest"), F.array(F.struct(F.lit(0).alias("which"), F.col("t").alias("x")))).otherwise(
        F.array(F.struct(F.lit(0).alias("which"), F.col("t").alias("x")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("x"))))).alias("v"))
    sketches = _sketch(both.select("bucket", "row", "v.which", F.col("v.x").alias("x")).select("bucket", "row", "which", _words("x").alias("term")), ["bucket", "row", "which"])
    w = Window.partitionBy("bucket").orderBy("row", "which")
    sketches = sketches.withColumn("e", F.lead("sig", 1).over(w)).withColumn("n", F.lead("sig", 2).over(w)).filter("which = 0").drop("which")
    joined = facts.join(sketches, ["bucket", "row"])
    return joined.select(
        F.col(key).alias(name), "n_chars", "edited_sha256", written(F.col("sig")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("e")).alias("near_edited"), likeness(F.col("sig"), F.col("n")).alias("near_next"),
    )
