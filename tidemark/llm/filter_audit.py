"""Filter interaction audit: what each filter removes in each order of the filters, and its share over all orders.

A row's failed filters are bits of a mask. Rows are counted by part and mask, so whatever the number of rows, a part is at
most 2 to the number of filters cells. Its orders are visited by single swaps of neighbours, each of which changes two
steps, computed again from the cells; what a filter removes is added up along the walk (its Shapley value, times the
number of orders).

Texts are read once and not shuffled: masks, parts and text hashes (SHA-256) go on as a table. The first of equal texts
is an aggregate with partial results, found again by hash and key, so a text that a third of all rows share is split.

Null text: read as the empty text. Null part: the empty string. Null key: such a row fails no test for copies, and makes no
other fail it. Repeated rows: each counts; equal texts with the same smallest key all pass. Several labels of one key: it
has a mark if one of them says so. Empty table: no rows. Very long text: one row of one task. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES
from tidemark.shipping import ship
from tidemark.tables import stored

#: Letters of the filters; the first has the lowest bit of a mask.
LETTERS = "ABCDE"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*_COUNTS, "shapley"))


def features(docs: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """id, part, hash, mask: the filters that look at a text alone (too short, repetitive, capitals, symbols)."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    blank = "[" + "".join(f"\\x{ord(c):02x}" for c in SPACES) + "]+"
    rows = rows.withColumn("w", F.filter(F.split("t", blank), lambda x: x != ""))
    n, capitals = F.size("w"), F.char_length("t") - F.char_length(F.regexp_replace("t", "[A-Z]+", ""))
    fails = (n < 200, 100 * F.size(F.array_distinct("w")) < 50 * n, 100 * capitals.cast("long") > 3 * F.char_length("t").cast("long"), F.col("t").rlike("[#$%&*|]"))
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("id", "part", F.unhex(F.sha2("t", 256)).alias("hash"), mask.alias("mask"))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """rows (id, hash, mask) with one more bit in the mask of those whose text also has a smaller id."""
    first = rows.groupBy("hash").agg(F.min("id").alias("id")).filter("id is not null").withColumn("__first", F.lit(True))
    found = rows.join(first, ["hash", "id"], "left")
    fails = F.col("id").isNotNull() & F.col("__first").isNull()
    return found.withColumn("mask", F.col("mask") + fails.cast("int") * (1 << bit)).drop("__first")


def cells(rows: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic from rows of part, mask, quality, toxic."""
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places i such that swapping i and i + 1, one after another, visits all orders of n things once."""
    if n < 2:
        return
    # The last thing sweeps through each order of the others, down and up in turn.
    down = True
    inner = swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        # It now stands in front or at the end, and the others behind it or before it.
        yield at + 1 if down else at
        down = not down


def walk(found: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> Iterator[tuple]:
    """filter_order, step, counts as in RESULT, shapley, from the cells of one part: mask -> (n, good, toxic)."""
    n = len(letters)

    def step(before: int, f: int) -> tuple[int, ...]:
        """Filter f after those of the set before."""
        bit = 1 << f
        fails = [(m, c) for m, c in found.items() if m & bit]
        here = [c for m, c in fails if not m & before]
        gone = sum(c[0] for c in here)
        return (
            sum(c[0] for m, c in found.items() if not m & (before | bit)), gone, sum(c[0] for _, c in fails) - gone,
            found.get(bit, (0, 0, 0))[0], sum(c[1] for c in here), sum(c[2] for c in here),
        )

    order, steps, before = list(range(n)), [], [0]
    for f in order:
        steps.append(step(before[-1], f))
        before.append(before[-1] | 1 << f)
    shapley, rows = [0] * n, []
    todo = swaps(n)
    while True:
        name = "".join(letters[f] for f in order)
        for i, f in enumerate(order):
            shapley[f] += steps[i][1]
            rows.append((name, i + 1, *steps[i], f))
        at = next(todo, None)
        if at is None:
            break
        order[at], order[at + 1] = order[at + 1], order[at]
        before[at + 1] = before[at] | 1 << order[at]
        steps[at : at + 2] = [step(before[at], order[at]), step(before[at + 1], order[at + 1])]
    for *r, f in rows:
        yield *r, shapley[f]


def interactions(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Rows as in RESULT from cells (part, mask, n, good, toxic); a part is at most 2 to the number of filters rows."""
    ship(counted.sparkSession)

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        found = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in own.itertuples()}
        rows = pd.DataFrame(walk(found, letters), columns=["filter_order", "step", *_COUNTS, "shapley"])
        rows.insert(0, "part", key[0])
        return rows

    return counted.groupBy("part").applyInPandas(work, RESULT)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """The audit of the five filters over documents: rows as in RESULT. labels: key, quality, toxic."""
    rows = stored(features(docs, key, part, text), "filter_masks")
    marks = labels.groupBy(F.col(key).alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return interactions(cells(with_copies(rows, LETTERS.index("E")).join(marks, "id", "left")))
