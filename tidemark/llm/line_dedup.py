"""Line dedup: lines that many documents share stay only in the last of these.

Lines are exploded with their keys (stripped of white space, A-Z lower-cased), keys are hashed to 128 bits, documents are
counted for each hash, and lines over the threshold are dropped. A document's text goes through one shuffle, to meet the
places of its dropped lines; all else that moves are hashes and places. Counts are aggregated before the shuffle, so a
line that a third of all documents hold is one row of each task; where such a line's places are looked up by its hash,
adaptive execution splits its partition.

Null text: read as the empty text, one empty line. Null key: below all others. Each row is a document: of repeated rows with
the same key all count, and all that have the largest key keep the line. Rows that are equal in key and text give equal
results. Empty table: no rows. Very long text: one row; its lines are rows, its places one list. Other columns pass through
untouched whatever their names, but one that is called as the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, SPACES, UPPER, renamed
from tidemark.tables import stored

LEAST_CHARS, LEAST_DOCS = 20, 3
_BLANK = "".join(f"\\u{ord(c):04x}" for c in SPACES)
_NEWLINE = "'\\n'"


def line_key(line: str) -> str:
    """SQL for a line's key. lower() does the same as translate() where all is ASCII, and is much faster."""
    bare = f"trim(BOTH '{_BLANK}' FROM {line})"
    return f"if(octet_length({line}) = char_length({line}), lower({bare}), translate({bare}, '{UPPER}', '{LOWER}'))"


def _places(least_chars: int) -> str:
    """SQL for array<struct<place, hash>> of the lines of t whose keys are long enough; places from 0."""
    keys = f"transform(split(t, {_NEWLINE}, -1), (x, i) -> named_struct('place', i, 'key', {line_key('x')}))"
    return f"transform(filter({keys}, x -> char_length(x.key) >= {least_chars}), x -> named_struct('place', x.place, 'hash', md5(x.key)))"


#: What is left of the lines of t without the places in the sorted list d: the stretches between them, so time grows with both and no faster.
_KEPT = f"""transform(array(split(t, {_NEWLINE}, -1)), l -> array_join(flatten(transform(sequence(0, size(d)), i ->
    slice(l, if(i = 0, 1, d[i - 1] + 2), if(i = size(d), size(l), d[i]) - if(i = 0, 0, d[i - 1] + 1)))), {_NEWLINE}))[0]"""


def repeated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """hash, docs, last: line hashes that at least so many documents (id, t) hold, and the largest id among these."""
    own = docs.select("id", F.explode(F.expr(f"array_distinct(transform({_places(least_chars)}, x -> x.hash))")).alias("hash"))
    found = own.select("id", F.unhex("hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last"))
    return found.filter(F.col("docs") >= least_docs)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "lines", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with shorter texts, and a column of n_lines (before) and n_dropped.

    A line goes if its key has least_chars code points or more and least_docs documents or more hold it, unless the
    document has the largest key of these.
    """
    docs, back = renamed(docs.drop(out))
    here = back.here(text)
    rows = docs.withColumns({"id": F.col(back.here(key)), "t": F.coalesce(F.col(here), F.lit(""))})
    shared = stored(repeated(rows.select("id", "t"), least_chars, least_docs), "repeated_lines")
    # Equal documents have equal results, so key and text name a document.
    rows = rows.withColumn("mark", F.unhex(F.md5("t")))
    at = rows.select("id", "mark", F.explode(F.expr(_places(least_chars))).alias("p")).select("id", "mark", F.col("p.place").alias("place"), F.unhex("p.hash").alias("hash"))
    at = at.join(shared.select("hash", "last"), "hash").filter(~F.col("id").eqNullSafe(F.col("last")))
    gone = at.groupBy("id", "mark").agg(F.array_sort(F.collect_set("place")).alias("d")).withColumnsRenamed({"id": "__id", "mark": "__mark"})
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    both = both.withColumn("__lines", F.struct(F.expr(f"cast(size(split(t, {_NEWLINE}, -1)) as bigint)").alias("n_lines"), F.coalesce(F.size("d"), F.lit(0)).cast("long").alias("n_dropped")))
    both = both.withColumn(here, F.expr(f"if(d is null, t, {_KEPT})"))
    return back(both, F.col("__lines").alias(out))
