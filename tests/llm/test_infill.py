import hashlib
import random
import re

import pytest

from tidemark.llm import infill
from tidemark.llm.q_infill import op11_fill_in_middle

random.seed(11)
TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "x" * 9000, "holds <M> already\n", "<P", "P>\n<", "<<S\n>M>\n\r\n\x85  no breaks\n", "é😀\n" * 300, "same\ntext\n", "same\ntext\n",
] + ["\n".join("<" * random.randint(0, 2) + "w" * random.randint(0, 300) for _ in range(random.randint(1, 400))) for _ in range(40)] + ["line of a very long text\n" * 60_000]


def plain(i, t):
    """The contract, word for word, with lists in place of ropes."""
    t = t or ""
    units, h = re.findall(r"[^\n]*\n|[^\n]+", t), hashlib.sha256(f"7:{i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 100:
        return n, "plain", None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_query_is_the_plain_version(spark, tmp_path):
    spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, infill long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_fill_in_middle(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in enumerate(TEXTS):
        n, form, p, m, out = plain(i, t)
        assert tuple(got[i]) == (i, n, form, p, m, sha(out), sha(t or ""))
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_rates_names_null_keys_and_empty(spark):
    docs = spark.createDataFrame([(None, "a\nb", 1, 2), (3, "c\nd", 1, 2), (3, "c\nd", 1, 2)], "doc_id long, text string, infill long, __r long")
    rows = infill.transform(docs).collect()
    assert len(rows) == 3 and all(r["__r"] == 2 for r in rows)
    assert rows[1].infill == rows[2].infill and infill.restored(rows[0].infill.output, rows[0].infill.form) == "a\nb"
    assert all(r.infill.form == "plain" for r in infill.transform(docs, rate=0).collect())
    assert all(r.infill.form == "spm" for r in infill.transform(docs, spm=100).collect())
    assert infill.transform(docs.limit(0)).count() == 0


def depth(x):
    return 0 if x is None or x.text is not None else 1 + max(depth(x.left), depth(x.right))


def test_ropes_split_and_join_anywhere():
    text = "".join(random.choice("ab\n" if i % 50 else "\n") for i in range(200_000))
    rope = infill.build(text)
    assert (rope.units, rope.chars) == (len(re.findall(r"[^\n]*\n|[^\n]+", text)), len(text))
    for _ in range(60):
        k = random.randint(0, rope.units)
        a, b = infill.split(rope, k, "units")
        assert (a.units if a else 0, b.units if b else 0) == (k, rope.units - k)
        rope = infill.concat(b, a)
        k = random.randint(0, rope.chars)
        a, b = infill.split(rope, k, "chars")
        assert (a.chars if a else 0) == k
        text = infill.written(rope)
        rope = infill.build(infill.written(a) + infill.written(b))
        assert infill.written(rope) == text
    # Many small cuts and joins leave a low tree with right counts.
    expected = infill.written(rope)
    for _ in range(2000):
        a, b = infill.split(rope, random.randint(0, rope.chars), "chars")
        rope = infill.concat(b, a)
        k = a.chars if a else 0
        expected = expected[k:] + expected[:k]
    assert infill.written(rope) == expected and rope.chars == len(expected) and depth(rope) <= 22


@pytest.mark.parametrize("output", ["", "no sentinel", "<P>a<S>b", "x<P>a<S>b<M>c"])
def test_malformed_output_is_null(output):
    assert infill.restored(output, "psm") is None
