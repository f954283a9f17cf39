import itertools
import random
import re

from tidemark.llm import filter_audit
from tidemark.llm.q_filter_audit import op13_filter_audit

random.seed(13)
WORDS = [f"w{i}" for i in range(150)]
TEXTS = [None, "", " \n", "A" * 50, "€ no ascii ß", "a b & c", "x y z " * 100, "W\x1cV\x85" * 300, "long " * 40_000] + [
    " ".join(random.choices([w.upper() if i % 3 == 0 else w for w in WORDS], k=random.choice([20, 199, 200, 400]))) + random.choice(["", "", "#", "|"]) for i in range(40)
]
ROWS = [(i, t, random.choice(["en", "de", None, ""])) for i, t in enumerate(TEXTS + TEXTS[:30] + TEXTS[5:20])]
LABELS = [(i, random.randint(0, 1), random.randint(0, 1)) for i in range(0, len(ROWS), 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]


def fails(t):
    w = re.findall("[^\x20\x09-\x0d]+", t)
    return "".join(c for c, f in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)))) if f)


def plain(rows, labels):
    """Every order over every document, without cells or walks."""
    docs = []
    for i, t, lang in rows:
        copy = any(j is not None and i is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
        docs.append((lang or "", fails(t or "") + "E" * copy, any(j == i and q for j, q, _ in labels if j is not None), any(j == i and x for j, _, x in labels if j is not None)))
    out = []
    for part in {d[0] for d in docs}:
        own, total, mine = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                again = sum(f in d[1] for d in own) - len(gone)
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                mine.append((part, "".join(order), k + 1, len(left), len(gone), again, sum(d[1] == f for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        out += [(*r, total[f]) for *r, f in mine]
    return sorted(out)


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, g, 1, 2) for i, t, g in rows], "doc_id long, text string, lang string, mask int, part int")
    return docs.repartition(4), spark.createDataFrame([(*x, 1) for x in LABELS], "doc_id long, quality int, toxic int, part int")


def test_query_is_the_plain_version(spark, tmp_path):
    for name, df in zip(("documents", "labels"), frames(spark, ROWS)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(tuple(r) for r in op13_filter_audit(spark, str(tmp_path)).collect())
    assert len(got) == 3 * 120 * 5 and got == plain(ROWS, LABELS)
    assert all(any(r[1][r[2] - 1] == f and r[4] for r in got) for f in "ABCDE")


def test_repeated_and_null_keys_and_empty(spark):
    rows = [(None, "t", "en"), (None, "t", "de"), (2, "t", "en"), (2, "t", None), (9, "t", "en"), (1, None, "en"), (3, "", "en")]
    docs, labels = frames(spark, rows)
    assert sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect()) == plain(rows, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in filter_audit.swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))
