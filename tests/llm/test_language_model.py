import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import language_model as lm
from tidemark.llm.q_language_model import op3_lm_scores

random.seed(9)
WORDS = [f"v{i}" for i in range(300)]
FIXED = "the quick brown fox jumps over the lazy dog".split()


def made():
    out = []
    for _ in range(random.randint(1, 12)):
        out += FIXED if random.random() < 0.4 else random.choices(WORDS, k=9)
    return " ".join(out)


TEXTS = [None, "", " \n", "Only ONCE here", "😀 É é"] + [made() for _ in range(150)] + ["x " * 50000]


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


class Plain:
    """The tree in dictionaries: every context of every length, from the definition."""

    def __init__(self, texts, numbered=None):
        self.n = Counter(x for t in texts for x in tokens(t))
        total, kinds = sum(self.n.values()), len(self.n)
        self.below = total + 0.5 * (kinds + 1)
        self.numbered = numbered or set(self.n)
        self.follow = [defaultdict(Counter) for _ in range(lm.DEPTH + 1)]
        for t in texts:
            w = [None] * lm.DEPTH + tokens(t)
            for i in range(lm.DEPTH, len(w)):
                for k in range(1, lm.DEPTH + 1):
                    self.follow[k][tuple(w[i - k : i])][w[i]] += 1
        self.kept = [{} for _ in range(lm.DEPTH + 1)]
        for k in range(1, lm.DEPTH + 1):
            for context, nexts in self.follow[k].items():
                c = sum(nexts.values())
                counted = {w: n for w, n in nexts.items() if n >= lm.MIN_COUNT and n >= lm.NEXT_SHARE * c}
                left = c - sum(counted.values()) + len(counted)
                s = {w: self.predict(context[1:], w)[0] for w in counted}
                p = {w: (n + left * s[w]) / (c + len(counted)) for w, n in counted.items()}
                gain = sum(n * math.log(p[w] / s[w]) for w, n in counted.items())
                if left > len(counted):
                    gain += (left - len(counted)) * math.log(left / (c + len(counted)))
                if counted and gain > lm.GAIN_EACH * len(counted) + lm.GAIN:
                    self.kept[k][context] = p, left / (c + len(counted))

    def root(self, w):
        return ((self.n[w] if w in self.numbered else 0) + 0.5) / self.below

    def predict(self, context, w):
        """The prediction, and whether it is left to the root."""
        if not context:
            return self.root(w), True
        found = self.kept[len(context)].get(context)
        if found and w in found[0]:
            return found[0][w], False
        p, fallen = self.predict(context[1:], w)
        return (p * found[1] if found else p), fallen

    def score(self, t):
        w, out = [None] * lm.DEPTH + tokens(t), 0.0
        for i in range(lm.DEPTH, len(w)):
            p, fallen = self.predict(tuple(w[i - lm.DEPTH : i]), w[i])
            out += math.log10(p / self.root(w[i]) * (self.n[w[i]] + 0.5) / self.below if fallen else p)
        return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n double").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("head, buckets, block", [(lm.HEAD, 128, lm.BLOCK), (100, 5, 3000), (0, 128, lm.BLOCK), (lm.HEAD, 10**6, 3000)])
def test_scores_equal_the_plain_tree(spark, docs, monkeypatch, head, buckets, block):
    for name, value in (("HEAD", head), ("BUCKETS", buckets), ("BLOCK", block)):
        monkeypatch.setattr(lm, name, value)
    rows = {r.doc_id: r for r in op3_lm_scores(spark, docs).collect()}
    train = [t for i, t in enumerate(TEXTS) if not held(i)]
    c = Counter(x for t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    sizes = sorted((x for x in c.values()), reverse=True)
    limit = next(1 << k for k in range(64) if sum(x >= 1 << k for x in sizes) <= head)
    tree = Plain(train, {w for w, k in c.items() if k >= limit} if head else {0})
    assert len(rows) == len(TEXTS)
    assert any(tree.kept[k] for k in (2, 3))
    for i, t in enumerate(TEXTS):
        w, r = tokens(t), rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, tree.score(t), rel_tol=1e-9)
    out = [r for r in rows.values() if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out)


def test_predictions_sum_to_one(spark, docs):
    tree = Plain([t for i, t in enumerate(TEXTS) if not held(i)])
    for k in (1, 2, 3):
        for context in list(tree.kept[k])[:40]:
            total = sum(tree.predict(context, w)[0] for w in tree.n) + tree.predict(context, b"never seen")[0]
            assert abs(total - 1) < 1e-9


def test_no_rows_no_training_rows_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b"), (3, None), (3, None)], "doc_id long, text string")
    assert lm.score(df).count() == 3
    assert lm.score(df.limit(0)).count() == 0
    out = next(i for i in range(100) if held(i))
    row = lm.score(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (row.n_known, row.train_tokens, row.base_score, row.score) == (0, 0, 0.0, 0.0)


def test_string_keys_and_other_columns(spark):
    rows = [(f"k{i % 3}", "a b c", i, i, i, i) for i in range(9)]
    got = lm.score(spark.createDataFrame(rows, "bucket string, text string, block long, what long, __text long, base long"), key="bucket").collect()
    assert sorted(r.bucket for r in got) == sorted(r[0] for r in rows)
    assert len({r.score for r in got}) == 1


def test_a_rare_phrase_in_a_large_corpus_is_kept(spark):
    # 18 million tokens: a share of 4e-7 of these is 7.2 occurrences, and the phrase has two.
    texts = ["a " * 200_000] * 90 + ["one two three four five six"] * 2
    keys = [i for i in range(10**4) if lm.remainder(i) != 1][: len(texts)]
    rows = {r.doc_id: r for r in lm.score(spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").repartition(8)).collect()}
    assert rows[keys[-1]].score > 0.5 * rows[keys[-1]].base_score


def test_keys_of_any_name(spark):
    for name, shown in (("__tail", "__tail"), ("word", "word"), ("n_tokens", "n_tokens_key"), ("score", "score_key")):
        got = lm.score(spark.createDataFrame([(1, "a b a b"), (2, "a b")], f"{name} long, text string"), name)
        assert got.columns[0] == shown and {r[0] for r in got.collect()} == {1, 2}
