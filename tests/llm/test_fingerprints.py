import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import fingerprints
from tidemark.llm.q_fingerprints import op4_fingerprints

random.seed(4)
WORDS = [f"w{i}" for i in range(60)]
TEXTS = [None, "", " \n ", "A b", "a B", "é😀x"] + [" ".join(random.choices(WORDS, k=random.randint(1, 300))) for _ in range(60)] + ["long " * 20000, "a b c"] + ["copy of a text"] * 5


def similarity(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(3 * i + 1, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, sig int").repartition(5).write.parquet(f"{at}/documents.parquet")
    return {r.doc_id: r for r in op4_fingerprints(spark, at).collect()}


def test_edited_texts_and_likeness(rows):
    assert len(rows) == len(TEXTS)
    texts, errors = [t or "" for t in TEXTS], []
    for i, t in enumerate(texts):
        r, after = rows[3 * i + 1], texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == after:
            assert r.near_next == 1
        errors += [r.near_edited - similarity(t, edited), r.near_next - similarity(t, after)]
    assert abs(sum(errors) / len(errors)) < 0.04 and max(map(abs, errors)) < 0.45
    by_text = {}
    for i, t in enumerate(texts):
        by_text.setdefault(t, set()).add(rows[3 * i + 1].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert rows[1].fingerprint == "" and len(rows[10].fingerprint) == 8 * fingerprints.SAMPLES


def test_collision_rate_is_the_weighted_similarity(spark):
    # 400 pairs of weighted sets; the error of a rate over SAMPLES draws has a known size.
    rng, pairs = random.Random(12), []
    for i in range(400):
        words = [f"p{i}w{j}" for j in range(rng.randint(2, 9))]
        pairs.append([" ".join(w for w in words for _ in range(rng.choice([0, 1, 1, 2, 5, 20]))) or "only" for _ in range(2)])
    rows = [(2 * i + k, t, 1, 2) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r.id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "id long, text string, sig long, __row long")).collect()}
    assert all((r.sig, r["__row"]) == (1, 2) for r in got.values())
    rate = lambda x, y: sum(x[k : k + 8] == y[k : k + 8] for k in range(0, len(x), 8)) / fingerprints.SAMPLES
    errors = [(rate(got[2 * i].fingerprint, got[2 * i + 1].fingerprint) - (j := similarity(*p)), j * (1 - j) / fingerprints.SAMPLES) for i, p in enumerate(pairs)]
    mean, expected = sum(e for e, _ in errors) / len(errors), sum(v for _, v in errors) / len(errors)
    assert abs(mean) < 4 * (expected / len(errors)) ** 0.5
    assert 0.8 < (sum(e * e for e, _ in errors) / len(errors) / expected) ** 0.5 < 1.2


def test_keys_that_are_texts_or_fractions(spark):
    for kind, key in (("string", lambda i: f"doc-{i:04d}"), ("double", lambda i: i / 4 - 3)):
        docs = spark.createDataFrame([(key(i), f"text {i} of many words") for i in range(300)], f"k {kind}, text string").repartition(5)
        got = {r.k: r.edited_sha256 for r in fingerprints.with_edited(docs, "k").collect()}
        for i in range(300):
            t, after = (f"text {x} of many words" for x in (i, (i + 1) % 300))
            assert got[key(i)] == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()


def test_keys_of_any_name(spark):
    for name in ("t", "bucket", "__key"):
        got = fingerprints.with_edited(spark.createDataFrame([(1, "a b"), (2, "c d")], f"{name} long, text string"), name)
        assert got.columns[0] == name and {r[0] for r in got.collect()} == {1, 2}
    got = fingerprints.with_edited(spark.createDataFrame([(1, "a b"), (2, "c d")], "n_chars long, text string"), "n_chars")
    assert got.columns[:2] == ["n_chars_key", "n_chars"] and sorted(r.n_chars_key for r in got.collect()) == [1, 2]


def test_quantiles_invert_the_distribution():
    import math

    for p in (0.01, 0.5, 0.99):
        x = fingerprints.gamma2_quantile(p)
        assert abs(1 - (1 + x) * math.exp(-x) - p) < 1e-9


def test_null_and_repeated_keys_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "c"), (7, "c"), (7, None)], "doc_id long, text string")
    assert fingerprints.with_edited(docs).count() == 4
    assert fingerprints.with_edited(docs.limit(0)).count() == 0
    one = fingerprints.with_edited(docs.filter("text = 'a b'")).first()
    assert one.near_next == 1
