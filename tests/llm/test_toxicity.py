import random
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity as tx
from tidemark.llm.q_toxicity import op6_toxicity

random.seed(12)
PLAIN = [a + b for a in ("bran", "tole", "miru", "sapi", "kond", "velu") for b in ("an", "er", "ix", "om", "ul", "et")]
BAD = ["zonker", "blimfat", "grubbly"]


def text(toxic):
    words = random.choices(PLAIN, k=random.randint(20, 60))
    for _ in range(random.randint(1, 4) if toxic else 0):
        w = random.choice([*BAD, "snarf" + random.choice(PLAIN)])
        if random.random() < 0.2 and w in BAD:
            k = random.randrange(1, len(w))
            w = w[:k] + random.choice("qxz") + w[k + 1 :]
        words.insert(random.randrange(len(words)), w)
    return " ".join(words)


def within_one(a, b):
    """Edit distance at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    for i in range(len(a) + 1):
        if a[:i] + a[i + 1 :] == b or (i < len(a) and i < len(b) and a[:i] + b[i] + a[i + 1 :] == b) or (i < len(b) and a[:i] + b[i] + a[i:] == b):
            return True
    return a == b


def test_automaton_equals_edit_distance():
    words = ["moron", "melon", "trash", "scum", "abcabc", "abcab"]
    lex = tx.Lexicon(words, ["stem"])
    rng = random.Random(1)
    for _ in range(20000):
        w = rng.choice(words)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcmnorst") + w[k:], w[:k] + rng.choice("abcmnorst") + w[k + 1 :]])
        if w in words:
            expected = tx.EXACT
        else:
            expected = tx.NEAR if len(w) >= tx.LONG - 1 and any(len(x) >= tx.LONG and within_one(w, x) for x in words) else 0
        assert lex.match(w) == expected, w
    assert [lex.match(w) for w in ("stem", "stemming", "ste", "")] == [tx.STEM, tx.STEM, 0, 0]


def test_context_tells_quotation_from_abuse():
    m = tx.Matcher(tx.Lexicon(["idiot"], []))
    assert [q for *_, q in m.matches(tx.words_of('you idiot . he said " idiot " ok then'))] == [False, True]
    assert [k for _, k, _ in m.matches(tx.words_of("1d10t Idiiot idio"))] == [tx.EXACT, tx.NEAR, tx.NEAR]


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tx, "MEMORY", 2)
    m = tx.Matcher(tx.Lexicon(["idiot", "moron"], []))
    assert [k for _, k, _ in m.matches(tx.words_of("a idiot b c d moron e f moroon"))] == [tx.EXACT, tx.EXACT, tx.NEAR]


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    rows = [(i, text(i % 4 == 0), "x", i % 4 == 0) for i in range(1200)] + [(1200, None, "x", False), (1201, "", "x", False), (1202, "zonker " * 20000, "x", True)]
    spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, score string").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], 1, int(r[3])) for r in rows if r[0] % 3] + [(5, 1, None), (None, 1, 1), (7, 1, 0), (7, 1, 0), (99999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return rows, {r.doc_id: r for r in op6_toxicity(spark, at).collect()}, at


def test_held_out_accuracy(scored):
    rows, got, _ = scored
    assert len(got) == len(rows)
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out == (r in out) for r in rows)
    assert np.mean([got[r[0]].predicted == r[3] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[1200].score == got[1201].score < 0.5 and got[1202].predicted == 1


def test_held_out_labels_change_nothing(spark, scored):
    rows, got, at = scored
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    again = {r.doc_id: r.score for r in tx.score(docs.select("doc_id", "text"), tx.fit(docs, flipped)).collect()}
    assert all(abs(again[k] - r.score) < 1e-9 for k, r in got.items())


def test_no_labels_and_no_rows(spark, scored):
    docs = spark.read.parquet(f"{scored[2]}/documents.parquet").limit(5)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tx.score(docs, tx.fit(docs, none)).collect()} == {0.0}
    assert tx.score(docs.limit(0), tx.fit(docs.limit(0), none)).count() == 0


def test_scores_equal_a_plain_version(spark):
    def one_off(a, b):
        """Whether one letter wrong, too many or too few makes b of a."""
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    rng = random.Random(31)
    plain = ["".join(rng.choices("bcdfglmnprst", k=rng.randint(3, 8))) for _ in range(200)]
    bad = ["zonker", "blimfat", "quargly"]
    rows = []
    for i in range(400):
        words = rng.choices(plain, k=rng.randint(0, 60))
        if i % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                w = rng.choice(bad)
                if rng.random() < 0.3:
                    k = rng.randrange(len(w))
                    w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "x" + w[k + 1 :]])
                words.insert(rng.randint(0, len(words)), rng.choice([w, w, f'said "{w}"']))
        rows.append((i, " ".join(words) if i else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    lexicon = model.lexicon
    for r in tx.score(docs, model).collect():
        words = tx.words_of(rows[r.doc_id][1])
        kinds = []
        for w in map(tx.plain, words):
            if any(w.startswith(s) for s in lexicon.stems):
                kinds.append(tx.STEM)
            elif w in lexicon.words:
                kinds.append(tx.EXACT)
            else:
                near = len(w) >= tx.LONG - 1 and w not in lexicon.clean and any(len(x) >= tx.LONG and one_off(w, x) for x in lexicon.words)
                kinds.append(tx.NEAR if near else 0)
        n = {}
        for i, k in enumerate(kinds):
            before, after = set(words[max(0, i - tx.WINDOW) : i]), set(words[i + 1 : i + 1 + tx.WINDOW])
            quoted = bool(before & tx.QUOTES and after & tx.QUOTES) or bool(before & tx.REPORTING)
            n[k, quoted] = n.get((k, quoted), 0) + 1
        abuse = sum(n.get((k, False), 0) for k in (1, 2, 3))
        near, stems = n.get((tx.NEAR, False), 0), n.get((tx.STEM, False), 0)
        quoted = sum(n.get((k, True), 0) for k in (1, 2, 3))
        x = [1, abuse > near, np.log1p(abuse - near), np.log1p(near), np.log1p(stems), np.log1p(quoted), 100 * abuse / (len(words) + 50)]
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))) < 1e-9
