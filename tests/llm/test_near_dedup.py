import random

import numpy as np
import pytest

from tidemark.llm import components
from tidemark.llm import near_dedup as nd
from tidemark.llm.components import connected
from tidemark.llm.q_near_dedup import op8_near_duplicates
from tidemark.llm.shingles import shingle_set, words_of

random.seed(8)
WORDS = [f"w{i}" for i in range(400)]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = random.choice(WORDS)
    return words


def corpus():
    texts = [None, "", " \t\n", "One two", "one  TWO", "a b c d e", "a b c d e f", "É two three", "é two three"]
    for _ in range(12):
        base = random.choices(WORDS, k=random.randint(20, 200))
        texts += [" ".join(edited(base, random.choice([0, 0, 1, 1, 2, 3, 5]))) for _ in range(random.choice([1, 2, 5, 40]))]
    chain = random.choices(WORDS, k=120)
    for _ in range(15):
        texts.append(" ".join(chain))
        chain = edited(chain, 2)
    texts += [texts[20]] * 30 + [" ".join(random.choices(WORDS, k=30000))]
    random.shuffle(texts)
    return texts


def plain(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_components_equal_all_pairs(spark, tmp_path):
    texts = corpus()
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_near_duplicates(spark, str(tmp_path)).collect()}
    roots, sizes = plain(texts)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (sizes[i], roots[i], roots[i] == i)


def test_null_and_repeated_keys_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "other"), (4, "other"), (None, None)], "doc_id long, text string")
    rows = sorted((r.n_shingles, r.component_id or -1) for r in nd.components(docs).collect())
    assert rows == [(0, -1), (1, 4), (1, 4), (2, 4), (2, 4)]
    assert nd.components(docs.limit(0)).count() == 0
    assert nd.survivors(docs.filter("doc_id is not null")).count() == 2


def test_registers_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**63, 3000, dtype="u8")
    for shared in (0.2, 0.5, 0.75, 0.95):
        # Two sets of equal size with this Jaccard similarity.
        n = int(2 * shared / (1 + shared) * 2000)
        x, y = a[:2000], np.concatenate([a[:n], rng.integers(0, 2**63, 2000 - n, dtype="u8")])
        sx, sy = nd.sketch([np.sort(x), np.sort(y)])
        n2 = np.array([2000.0])
        assert abs(nd.likelihood_estimate(sx[None], sy[None], n2, n2, nd.B)[0] - shared) < 0.15
        fx, fy = nd.registers(nd.minima([np.sort(x), np.sort(y)], nd.FINE), nd.FINE_B, nd.FINE_Q)
        assert abs(nd.likelihood_estimate(fx[None], fy[None], n2, n2)[0] - shared) < 0.08
        assert (nd.merge(sx, sy) == nd.sketch([np.union1d(x, y)])[0]).all()


def test_shingle_hashes_are_those_of_the_words():
    w = words_of("A b  c\nd e f a b c d e")
    assert len(shingle_set(w)) == 6
    assert (shingle_set(words_of("x y z")) == shingle_set(words_of(" X  y\tz "))).all()
    assert not set(shingle_set(words_of("x y z")).tolist()) & set(shingle_set(words_of("x yz")).tolist())


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(50)] + [(60, 61), (61, 62), (62, 60)]])
@pytest.mark.parametrize("local", [0, 100])
def test_connected(spark, monkeypatch, edges, local):
    monkeypatch.setattr(components, "LOCAL", local)
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_key_names_and_columns_that_clash(spark):
    rows = [(i, "a b c d e f g h", i, i, i, i) for i in range(3)] + [(3, None, 3, 3, 3, 3)]
    df = spark.createDataFrame(rows, "n long, text string, ident long, kept long, __key long, __n long")
    assert {(r.n, r.component_id, r.kept) for r in nd.components(df, "n").collect()} == {(0, 0, True), (1, 0, False), (2, 0, False), (3, 3, True)}
    assert sorted(nd.survivors(df, "n").collect()) == [rows[0], rows[3]]


def test_stars_on_a_large_graph(spark, monkeypatch):

    monkeypatch.setattr(components, "LOCAL", 1000)
    # Chains, a star and pairs: 30,000 nodes, far more edges than one task would take.
    edges = [(i, i + 1) for i in range(10_000) if i % 100] + [(20_000, 20_001 + i) for i in range(5000)] + [(30_000 + 2 * i, 30_001 + 2 * i) for i in range(5000)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    want = {}
    for a, b in sorted(edges):
        want.setdefault(a, a)
        want[b] = want[a]
    assert got == want
