"""Which expectations are complete, and which rest on a stream that lost something."""

from __future__ import annotations

import re
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.columns import glob_to_regex
from tidemark.operators.sequence import accepted, running
from tidemark.shipping import ship

RANKS = {"complete": 0, "suspect": 1, "adopted": 2}
#: Patterns that are tried one by one in a single expression.
PATTERNS = 1024


def floors(judged: DataFrame, errors: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """order, reason: the moments at which everything written before became suspect."""
    found = judged.filter("verdict in ('with_gap', 'after_restart')").select(F.col("arrival").alias("order"), F.when(F.col("verdict") == "with_gap", "seq_gap").otherwise("restart").alias("reason"))
    if errors is not None:
        found = found.unionByName(errors.select(F.col("arrival").alias("order"), F.lit("decode_error").alias("reason")))
    if signals is not None:
        found = found.unionByName(signals.select(F.col("arrival").alias("order"), F.lit("source_gap").alias("reason")))
    return found


def effective_trust(state: DataFrame, floor: DataFrame, clear: DataFrame | None = None) -> DataFrame:
    """state with trust: suspect if the key was last written before the last floor, unless a snapshot ended since.

    Both sides are one row, so they are joined as such.
    """
    last = floor.agg(F.max("order").alias("__floor"))
    cleared = clear.agg(F.max("order").alias("__clear")) if clear is not None else last.select(F.lit(None).cast("long").alias("__clear"))
    rows = state.join(F.broadcast(last)).join(F.broadcast(cleared))
    suspect = (F.col("last_order") < F.col("__floor")) & (F.coalesce("__clear", F.lit(-1)) < F.col("__floor"))
    return rows.withColumn("trust", F.when(suspect, "suspect").otherwise("complete")).drop("__floor", "__clear")


def mark_pattern(rows: DataFrame, pattern: str) -> DataFrame:
    """Complete rows whose key matches the shell pattern become suspect; a malformed pattern matches nothing."""
    regex = glob_to_regex(pattern)
    hit = F.col("key").rlike(regex) if regex else F.lit(False)
    return rows.withColumn("trust", F.when((F.col("trust") == "complete") & hit, "suspect").otherwise(F.col("trust")))


def mark_patterns(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same with a table of patterns (regex), one for each damaged publisher, however many: usually a few rows, which are tried on every key.

    Where there are more than PATTERNS, keys and patterns meet by the literal text that a pattern begins or ends with.
    """
    regexes = patterns.filter("regex is not null").select("regex").distinct()
    few = [r.regex for r in regexes.limit(PATTERNS + 1).collect()]
    if len(few) > PATTERNS:
        keys = rows.filter((F.col("trust") == "complete") & F.col("key").isNotNull()).select("key").distinct()
        found = _met(keys, regexes.select("regex", _ends("regex").alias("ends"))).select("key").distinct().withColumn("__hit", F.lit(True))
        rows = rows.join(found, "key", "left")
        return rows.withColumn("trust", F.when((F.col("trust") == "complete") & F.col("__hit"), "suspect").otherwise(F.col("trust"))).drop("__hit")
    hit = F.lit(False)
    for x in few:
        hit = hit | F.col("key").rlike(x)
    return rows.withColumn("trust", F.when((F.col("trust") == "complete") & hit, "suspect").otherwise(F.col("trust")))


def literal_ends(regex: str | None) -> tuple[str, str]:
    """The literal text that whatever matches must begin and end with. Of expressions that glob_to_regex() did not make, only a plain beginning behind ^ is used."""
    if regex is None:
        return "", ""
    if not (regex.startswith("(?s)^") and regex.endswith("$")):
        plain = re.match(r"\^([\w:/ -]*)([*?{+]?)", regex)
        return ("", "") if plain is None or "|" in regex else (plain[1][: -1 if plain[2] else None], "")
    body = regex.removeprefix("(?s)^").removesuffix("$")
    parts = [m[0] for m in re.finditer(r"\\.|\[\^?\]?[^\]]*\][*]?|[.]\*?|.", body, re.S)]
    plain = [x[1] if len(x) == 2 and x[0] == "\\" else x if len(x) == 1 and x != "." else None for x in parts]
    whole = lambda xs: "".join(takewhile(lambda x: x is not None, xs))
    return whole(plain), whole(reversed(plain))[::-1]


def _ends(regex: str) -> Column:
    return F.udf(literal_ends, StructType([StructField("prefix", StringType()), StructField("suffix", StringType())]), useArrow=False)(regex)


def _met(keys: DataFrame, patterns: DataFrame) -> DataFrame:
    """key and the columns of patterns (regex, ends, ...) for each pattern that matches the key.

    An equi-join on the longer literal end of a pattern, checked by its expression: a key is looked up once for each
    different length of such ends. Patterns without any literal end meet all keys.
    """
    ship(keys.sparkSession)
    front = F.char_length("ends.prefix") >= F.char_length("ends.suffix")
    sides = patterns.withColumns({"__front": front, "__end": F.when(front, F.col("ends.prefix")).otherwise(F.col("ends.suffix"))}).withColumn("__n", F.char_length("__end")).drop("ends")
    sizes = sides.select("__front", "__n").distinct().collect()  # at most two for each length that a key can have
    if not sizes:
        return keys.limit(0).join(sides.drop("__front", "__end", "__n"), F.lit(True))
    cut = lambda r: F.left("key", F.lit(r["__n"])) if r["__front"] else F.right("key", F.lit(r["__n"]))
    looks = F.array(*[F.when(F.char_length("key") >= r["__n"], F.struct(F.lit(r["__front"]).alias("f"), cut(r).alias("e"))) for r in sizes])
    rows = keys.select("key", F.explode(F.array_compact(looks)).alias("__l"))
    met = rows.join(sides, (F.col("__l.f") == F.col("__front")) & (F.col("__l.e") == F.col("__end")))
    return met.filter(F.expr("key rlike regex")).drop("__l", "__front", "__end", "__n")


def scoped(publisher: Column, ownership: str | None) -> Column:
    """scope() of a column of publishers."""
    return F.replace(F.lit(ownership), F.lit("{{.Publisher}}"), publisher) if ownership else F.lit("")


def marks(judged: DataFrame, ownership: str | None = None, errors: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """order, pattern, reason: floors() with the keys they are about; an empty pattern is all keys. Only gaps and restarts have a publisher."""
    own = judged.filter("verdict in ('with_gap', 'after_restart')")
    found = own.select(F.col("arrival").alias("order"), scoped(F.col("publisher"), ownership).alias("pattern"), F.when(F.col("verdict") == "with_gap", "seq_gap").otherwise("restart").alias("reason"))
    for more, why in ((errors, "decode_error"), (signals, "source_gap")):
        if more is not None:
            found = found.unionByName(more.select(F.col("arrival").alias("order"), F.lit("").alias("pattern"), F.lit(why).alias("reason")))
    return found


def clears(judged: DataFrame, ownership: str | None = None) -> DataFrame:
    """order, pattern: the moments at which a publisher had sent all it holds."""
    return judged.filter("op = 'snapshot_end'").select(F.col("arrival").alias("order"), scoped(F.col("publisher"), ownership).alias("pattern"))


def latest(marked: DataFrame, cleared: DataFrame) -> DataFrame:
    """pattern, marked, cleared: the last order of either, which is all that trust depends on; one row for each pattern."""
    both = marked.select("pattern", F.col("order").alias("m"), F.lit(None).cast("long").alias("c")).unionByName(cleared.select("pattern", F.lit(None).cast("long").alias("m"), F.col("order").alias("c")))
    return both.groupBy("pattern").agg(F.max("m").alias("marked"), F.max("c").alias("cleared"))


def effective(state: DataFrame, found: DataFrame, ownership: str | None = None) -> DataFrame:
    """state (key, stamp, last_order) with trust: what its last write was stamped with, unless a mark or a clearing came after that; the later one decides.

    found: see latest(). Adopted keys stay adopted. Patterns meet keys by their literal ends, never all with all.
    """
    whole = found.filter("pattern = ''").agg(F.max("marked").alias("__m"), F.max("cleared").alias("__c"))
    rows = state.join(F.broadcast(whole))  # one row
    if ownership:
        some = found.filter("pattern <> ''").withColumn("regex", F.udf(glob_to_regex, StringType(), useArrow=False)("pattern")).withColumn("ends", _ends("regex")).filter("regex is not null")
        own = _met(state.select("key"), some).groupBy("key").agg(F.max("marked").alias("__pm"), F.max("cleared").alias("__pc"))
        rows = rows.join(own, "key", "left")
        rows = rows.withColumns({"__m": F.greatest("__m", "__pm"), "__c": F.greatest("__c", "__pc")}).drop("__pm", "__pc")
    m, c = F.coalesce("__m", F.lit(-2)), F.coalesce("__c", F.lit(-2))
    suspect = F.when(F.greatest(m, c) > F.col("last_order"), m > c).otherwise(F.col("stamp") == "suspect")
    return rows.withColumn("trust", F.when(F.col("stamp") == "adopted", "adopted").when(suspect, "suspect").otherwise("complete")).drop("__m", "__c")


def stamps(judged: DataFrame) -> DataFrame:
    """judged with stamp: stamped(), but a snapshot's end makes its publisher's writes complete again until the next gap.

    Where intervals were merged (truncated) nobody knows any more what is missing, and the publisher stays suspect as well.
    """
    rows = stamped(judged).withColumnRenamed("trust", "stamp")
    if "truncated" in judged.columns:
        rows = rows.withColumn("stamp", F.when(F.col("truncated"), "suspect").otherwise(F.col("stamp")))
    at = lambda c: F.when(c, F.col("arrival"))
    rows = running(rows, ["publisher"], "arrival", {"__g": at(F.col("verdict") == "with_gap"), "__s": at(F.col("op") == "snapshot_end")})
    gap, end = F.greatest("__g", at(F.col("verdict") == "with_gap")), F.greatest("__s", at(F.col("op") == "snapshot_end"))
    return rows.withColumn("stamp", F.when((F.col("stamp") == "suspect") & (F.coalesce(end, F.lit(-1)) < F.coalesce(gap, F.lit(0))), "suspect").otherwise("complete")).drop("__g", "__s")


def scope(publisher: str, ownership: str | None) -> str:
    """The pattern of keys that a publisher's loss makes suspect: its own if keys are partitioned, else all (empty)."""
    return ownership.replace("{{.Publisher}}", publisher) if ownership else ""


def stamped(judged: DataFrame) -> DataFrame:
    """judged with trust at the time of each write: suspect while its publisher misses a number in its epoch.

    Missing so far is the highest number less the first, plus one, less the different numbers seen, which are those accepted.
    """
    keys = ["publisher", "epoch", "incarnation"]
    rows = judged.filter("verdict <> 'stale_epoch'")
    new = accepted(F.col("verdict"))
    base = F.when(F.col("verdict").isin("first_seen", "after_restart"), F.col("seq"))
    rows = running(rows, keys, "arrival", {"__high": F.col("seq"), "__base": base}, sums={"__seen": new.cast("long")})
    first = F.coalesce("__base", base)
    missing = F.greatest("__high", "seq", first) - first + 1 - F.col("__seen") - new.cast("long")
    return rows.withColumn("trust", F.when(missing > 0, "suspect").otherwise("complete")).drop("__base", "__high", "__seen")


def multi_writers(events: DataFrame) -> DataFrame:
    """key, writers: keys that more than one publisher wrote."""
    found = events.groupBy("key").agg(F.countDistinct("publisher").alias("writers"))
    return found.filter("writers > 1")


def worst(*trusts: Column) -> Column:
    """The least trusted of several states."""
    rank = [F.when(t == "adopted", 2).when(t == "suspect", 1).otherwise(0) for t in trusts]
    top = F.greatest(*rank) if len(rank) > 1 else rank[0]
    return F.when(top == 2, "adopted").when(top == 1, "suspect").otherwise("complete")
