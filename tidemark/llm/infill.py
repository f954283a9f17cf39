"""Fill-in-middle: texts cut at two unit ranks and put together again in another order, by ropes.

A rope is a balanced tree whose leaves hold pieces of a text and cache how many units (lines) and code points they have, as
inner nodes do for what is below them. Cutting a text at a rank splits the tree along one path; the three parts and the
sentinels between them are concatenated as trees. The way back builds the rope of the output, splits it at the code-point
ranks of the sentinels, and concatenates the parts in their old order.

Each text is one row of one task and nothing is shuffled; cuts and forms come from a hash of the key, so a task that runs
again gives the same. Null text: read as the empty text, which stays plain (no units). Null key: hashed as the empty
text. Repeated rows: each gives the same result. Empty table: no rows. A text of one very long line is one leaf. Other columns
pass through untouched whatever their names, but one that is called as the result is replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.common import renamed
from tidemark.shipping import ship

# Fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Which part follows which sentinel, by form; parts are numbered prefix 0, middle 1, suffix 2.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
#: A leaf is closed at the first line end at or after so many code points.
LEAF = 2048
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


class Rope:
    """A leaf (text) or an inner node (left, right), with counts of units and code points. None stands for no text."""

    __slots__ = ("text", "left", "right", "units", "chars", "height")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        if text is not None:
            # In a text's own rope only the last leaf can have a line without an end.
            self.units, self.chars, self.height = text.count("\n") + (text[-1] != "\n"), len(text), 0
        else:
            self.units, self.chars, self.height = left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height)


def build(text: str) -> Rope | None:
    """The rope of a text: leaves of whole lines, joined in pairs until one is left."""
    level, at = [], 0
    while at < len(text):
        end = text.find("\n", at + LEAF - 1) + 1 or len(text)
        level.append(Rope(text[at:end]))
        at = end
    while len(level) > 1:
        level = [Rope(None, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else None


def concat(a: Rope | None, b: Rope | None) -> Rope | None:
    """One tree of two: the lower one is put into the higher one's near side, and rotations keep heights even."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return _even(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return _even(concat(a, b.left), b.right)
    return Rope(None, a, b)


def _even(a: Rope, b: Rope) -> Rope:
    if b.height > a.height + 1:
        if b.left.height > b.right.height:
            return Rope(None, Rope(None, a, b.left.left), Rope(None, b.left.right, b.right))
        return Rope(None, Rope(None, a, b.left), b.right)
    if a.height > b.height + 1:
        if a.right.height > a.left.height:
            return Rope(None, Rope(None, a.left, a.right.left), Rope(None, a.right.right, b))
        return Rope(None, a.left, Rope(None, a.right, b))
    return Rope(None, a, b)


def split(rope: Rope | None, rank: int, by: str) -> tuple[Rope | None, Rope | None]:
    """What comes before a rank of units or chars, and the rest."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= getattr(rope, by):
        return rope, None
    if rope.text is None:
        here = getattr(rope.left, by)
        if rank < here:
            a, b = split(rope.left, rank, by)
            return a, concat(b, rope.right)
        a, b = split(rope.right, rank - here, by)
        return concat(rope.left, a), b
    at = rank
    if by == "units":
        at = 0
        for _ in range(rank):
            at = rope.text.index("\n", at) + 1
    return Rope(rope.text[:at]), Rope(rope.text[at:])


def written(rope: Rope | None) -> str:
    out, todo = [], [rope] if rope else []
    while todo:
        x = todo.pop()
        if x.text is None:
            todo += (x.right, x.left)
        else:
            out.append(x.text)
    return "".join(out)


def rearranged(text: str, draws: list[int], rate: int, spm: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text, from four random numbers."""
    rope = build(text)
    n = rope.units if rope else 0
    if not n or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    rest, suffix = split(rope, hi, "units")
    prefix, middle = split(rest, lo, "units")
    form, parts, out = "spm" if draws[3] % 100 < spm else "psm", (prefix, middle, suffix), None
    for sentinel, part in FORMS[form]:
        out = concat(concat(out, Rope(sentinel)), parts[part])
    chars = lambda x: x.chars if x else 0
    return n, form, chars(prefix), chars(middle), written(out)


def restored(output: str, form: str) -> str | None:
    """The text that rearranged() had; None where the output is not of that form."""
    if form == "plain":
        return output
    rest, parts, at, before = build(output), [None] * 3, 0, None
    for sentinel, part in FORMS[form]:
        found = output.find(sentinel, at)
        if found < 0 or before is None and found > 0:
            return None
        between, rest = split(rest, found - at, "chars")
        if before is not None:
            parts[before] = between
        _, rest = split(rest, len(sentinel), "chars")
        at, before = found + len(sentinel), part
    parts[before] = rest
    return written(concat(concat(parts[0], parts[1]), parts[2]))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "infill", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """docs with a column of n, form (plain, psm, spm), prefix_chars, middle_chars, output.

    Of 100 texts, rate are rearranged, of these spm with the suffix first. Texts that hold a sentinel stay plain.
    """
    ship(docs.sparkSession)
    docs, back = renamed(docs.drop(out))

    @F.pandas_udf(RESULT)
    def work(t: pd.Series, drawn: pd.Series) -> pd.DataFrame:
        rows = [rearranged(x, [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)], rate, spm) for x, h in zip(t, drawn)]
        found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(back.here(key)).cast("string"), F.lit(""))), 256)
    return back(docs.withColumn("__r", work(F.coalesce(F.col(back.here(text)), F.lit("")), drawn)), F.col("__r").alias(out))


def original(output: Column, form: Column) -> Column:
    """The exact text behind an output and its form; null where one is null or they do not belong together."""

    @F.pandas_udf(StringType())
    def work(o: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else restored(x, y) for x, y in zip(o, f)], dtype=object)

    return work(output, form)
