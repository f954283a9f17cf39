"""URL filters: host and path rules first, then a ratio of two character language models.

The models are smoothed variable-order Markov models over host and path, one for accepted and one for rejected URLs,
learnt from the URLs that a rule decides. A character is scored under the longest context whose gram the model kept; a
gram's probability is interpolated with that of its shorter context. The verdict compares the mean log-likelihood
difference per character with a threshold at which both kinds of error are as likely on the training URLs.

Only DataFrame operations. Grams are counted with map-side sums, so a host with a third of all URLs sends no more than
any other. A gram is kept if it makes up MIN_SHARE of all grams at least, so the model has ORDER / MIN_SHARE rows at
most, whatever the input, and may be broadcast.

Null URL, or one without "://": empty host and path, no rule, judged by the model. Repeated rows: one output row each.
No decided URLs of one kind: the model's verdict is allow. Empty table: no rows. Very long URL: as many rows as it has
characters, for the time of scoring. Other columns pass through; those called as a result's column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, materialize, union_all

ORDER, MIN_SHARE, MIN_COUNT, WEIGHT, SYMBOLS = 5, 2e-5, 2, 4.0, 256
START, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(found, pattern, 1)), F.regexp_extract(found, pattern, 2)


def longest_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule (verdict, host/path) that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _positions(urls: DataFrame) -> DataFrame:
    """One row per character to predict: t is the framed text, i the place of the character in it; urls has no such columns."""
    return urls.withColumn("t", F.concat(F.lit(START), "host", "path", F.lit(END))).withColumn("i", F.explode(F.sequence(F.lit(2), F.length("t"))))


def gram(n: int) -> Column:
    return F.when(F.col("i") >= n, F.substring("t", F.col("i") - (n - 1), F.lit(n)))


def train(decided: DataFrame) -> DataFrame:
    """gram, n, ratio from URLs with host, path and verdict: ratio is the log10 odds of accepted to rejected for its last character."""
    grams = _positions(decided.select("host", "path", "verdict")).select("verdict", F.explode(F.array(*[gram(n) for n in range(1, ORDER + 1)])).alias("gram"))
    is_allow = F.col("verdict") == "allow"
    counts = grams.filter("gram is not null").groupBy("gram").agg(F.count(F.when(is_allow, 1)).alias("a"), F.count(F.when(~is_allow, 1)).alias("r"))
    counts = materialize(counts.withColumn("n", F.length("gram")), "grams")
    total = counts.filter("n = 1").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr")).first()
    ta, tr = total.ta or 0, total.tr or 0
    kept = materialize(counts.filter(F.col("a") + F.col("r") >= max(MIN_COUNT, MIN_SHARE * (ta + tr))), "kept")
    starts = F.lit(START)
    # The start mark is only ever a context; as such it occurs once in each URL.
    framed = decided.agg(F.count(F.when(is_allow, 1)).alias("a"), F.count(F.when(~is_allow, 1)).alias("r")).select(starts.alias("ctx"), F.col("a").alias("ca"), F.col("r").alias("cr"))
    contexts = kept.select(F.col("gram").alias("ctx"), F.col("a").alias("ca"), F.col("r").alias("cr")).unionByName(framed)
    base = lambda c, total: (F.col(c) + 0.5) / F.lit(total + 0.5 * SYMBOLS)
    levels = [kept.filter("n = 1").select("gram", base("a", ta).alias("pa"), base("r", tr).alias("pr"))]
    for n in range(2, ORDER + 1):
        low = levels[-1].select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        rows = kept.filter(F.col("n") == n).withColumn("ctx", F.substring("gram", 1, n - 1)).withColumn("shorter", F.substring("gram", 2, n - 1))
        # A kept gram's context and shorter gram occur at least as often, so they are kept too.
        rows = rows.join(F.broadcast(contexts), "ctx").join(F.broadcast(low), "shorter")
        mixed = lambda c, ctx, q: (F.col(c) + WEIGHT * F.col(q)) / (F.col(ctx) + WEIGHT)
        levels.append(materialize(rows.select("gram", mixed("a", "ca", "qa").alias("pa"), mixed("r", "cr", "qr").alias("pr")), "order"))
    return materialize(union_all(levels).select("gram", (F.log10("pa") - F.log10("pr")).alias("ratio")), "ratios")


def score(urls: DataFrame, model: DataFrame, out: str = "score") -> DataFrame:
    """urls (with host and path, and no t, i, __row or __g1 and so on) plus the mean ratio per character. Each row is its own group, by a number that only groups."""
    names = urls.columns
    rows = _positions(urls.withColumn("__row", F.monotonically_increasing_id()))
    best = F.lit(0.0)
    for n in range(1, ORDER + 1):
        rows = rows.withColumn(f"__g{n}", gram(n)).join(F.broadcast(model.select(F.col("gram").alias(f"__g{n}"), F.col("ratio").alias(f"__r{n}"))), f"__g{n}", "left")
        best = F.coalesce(F.col(f"__r{n}"), best)
    return rows.groupBy("__row", *names).agg(F.avg(best).alias(out)).select(*names, out)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """pages plus host, path, rule, verdict, score and threshold."""
    made = ("host", "path", "rule", "verdict", "score", "threshold")
    host, path = host_and_path(F.col(url).alias("u"))
    # All columns of pages stay in one, so that no name clashes with those of the grams.
    rest = F.struct(*[c for c in pages.columns if c.lower() not in made], F.lit(True).alias("__any_page"))
    parsed = pages.select(rest.alias("page_"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    parsed = parsed.withColumn("rule", rule).withColumn("verdict", verdict)
    scored = materialize(score(parsed, train(parsed.filter("verdict is not null"))), "scored")
    kinds = {r.verdict: r for r in scored.filter("verdict is not null").groupBy("verdict").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev")).collect()}
    a, r = kinds.get("allow"), kinds.get("block")
    limit = None
    if a and r:
        da, dr = max(a.dev, 1e-9), max(r.dev, 1e-9)
        limit = (a.mean * dr + r.mean * da) / (da + dr)
    own = F.when(F.col("score") < limit, "block").otherwise("allow") if limit is not None else F.lit("allow")
    done = scored.withColumn("verdict", F.coalesce("verdict", own)).withColumn("threshold", F.lit(limit).cast("double"))
    return done.select("page_.*", *made).drop("__any_page")
