import hashlib
import random

from tidemark.llm import line_dedup
from tidemark.llm.q_line_dedup import op12_line_dedup

random.seed(12)
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARED = ["A Line That Many Documents Share", "É, ein Über-Satz in vielen Texten", "exactly twenty chars", "nineteen characters", " twenty with a hard space", "İstanbul KELVIN K sign here", "istanbul kelvin k sign here"]
TEXTS = [None, "", "\n", "\n\n", "only " * 30, "a line that many documents share  \n\nTail\r"] + [
    "\n".join(random.choice(["", " ", "\t\x0b"]) + random.choice(SHARED + [f"a line of document {i} alone"] * 3) + random.choice(["", "\r", " \t"]) for _ in range(random.randint(1, 12))) for i in range(60)
] + ["\n".join(SHARED * 2000)] + ["A LINE THAT MANY DOCUMENTS SHARE"] * 3


def plain(rows, least_chars=20, least_docs=3):
    """(n_lines, n_dropped, kept) of each (id, text); a row is a document."""
    key = lambda x: x.strip(SPACES).translate(LOWER)
    seen = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen.setdefault(k, []).append(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(s := seen[key(x)]) < least_docs or (-1 if i is None else i) == max(s)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_query_is_the_plain_version(spark, tmp_path):
    rows = [(3 * i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, hash int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op12_line_dedup(spark, str(tmp_path)).collect())
    assert got == [(i, n, d, hashlib.sha256(x.encode()).hexdigest()) for (i, _), (n, d, x) in zip(rows, plain(rows))]
    assert sum(r[2] for r in got) > 1000 and any(r[2] == r[1] for r in got)


def test_repeated_and_null_keys_clashing_names_and_empty(spark):
    rows = [(None, "the same long line everywhere\nx"), (None, "the same long line everywhere"), (7, "the same long line everywhere\ny"), (7, "the same long line everywhere\ny"), (7, None), (5, "The Same Long Line Everywhere")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "id long, T string, mark int, d int, lines int, hash int").repartition(2)
    got = line_dedup.dedup(docs, "id", "T").collect()
    assert sorted((r.id or -1, *r.lines, r["T"]) for r in got) == sorted((i or -1, n, d, x) for (i, _), (n, d, x) in zip(rows, plain(rows)))
    assert all((r.mark, r.d, r.hash) == (1, 2, 4) for r in got)
    assert line_dedup.dedup(docs.limit(0), "id", "T").count() == 0
    alone = docs.filter("id is null").unionByName(docs.filter("id is null"))
    assert all(r.lines.n_dropped == 0 for r in line_dedup.dedup(alone, "id", "T").collect())


def test_other_limits(spark):
    rows = [(i, f"abc\nline {i % 2}") for i in range(4)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), least_chars=3, least_docs=2).orderBy("doc_id").collect()
    assert [(*r.lines, r.text) for r in got] == plain(rows, 3, 2)
