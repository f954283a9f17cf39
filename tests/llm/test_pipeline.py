import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import near_dedup, toxicity

random.seed(21)
WORDS = ["".join(random.choices("abcdefghijklmnoprstu", k=random.randint(3, 9))) for _ in range(300)]


def made():
    rows = []
    for i in range(260):
        words = random.choices(WORDS, k=random.randint(5, 400))
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(random.randrange(len(words)), random.choice(["zonker", "blimfat"]))
        if i % 11 == 0:
            words.insert(3, "password=abcdef123456")
        if i % 13 == 5 and not toxic and not rows[i - 1][5]:
            words = rows[i - 1][1].split() if rows[i - 1][1] else words
        rows.append((i, " ".join(words), "en", "s0", 0, toxic))
    rows += [(260, None, None, None, None, False), (261, "", "en", "s0", 0, False)]
    return [(i, t, lang, src, len(t) if t is not None else n, x) for i, t, lang, src, n, x in rows]


def test_stages_equal_a_plain_version(spark, tmp_path):
    rows = made()
    at = str(tmp_path)
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[5])) for r in rows if r[0] % 5], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs, steps = spark.read.parquet(f"{at}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        assert docs.columns == columns
        steps.append({r.doc_id: r for r in docs.collect()})
    clean = {r[0] for r in rows if not r[5]}
    assert clean == set(steps[0])

    texts = {k: steps[0][k].text for k in sorted(steps[0])}
    sets = {k: set(s) if len(s) or not w else {tuple(w)} for k, t in texts.items() for w in [(t or "").lower().split()] for s in [[tuple(w[i : i + 5]) for i in range(len(w) - 4)]]}
    gone = {b for b in texts for a in texts if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert gone and set(steps[1]) == set(texts) - gone

    for k, r in steps[2].items():
        t = steps[1][k].text
        assert r.text == (t if t is None else re.sub(r"password=[a-z0-9]+", "[secret]", t))
        assert r.n_chars == (None if t is None else len(r.text))

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    placed = corpus_pipeline.run(spark, at).collect()
    length, fill = {}, {}
    for p in placed:
        length[p.doc_id] = length.get(p.doc_id, 0) + p.length
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    assert length == {k: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for k, r in steps[2].items()}
    assert max(fill.values()) <= 1024 and len(fill) <= np.ceil(sum(fill.values()) / 1024) + 2


def test_survivors_of_repeated_keys(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 6), (2, "A  b c", 7), (3, "", 8), (3, None, 9), (None, "q", 1)], "doc_id long, text string, kept int")
    got = sorted((str(r.doc_id), r.text or "") for r in near_dedup.survivors(docs).collect())
    assert got == [("1", "a b c"), ("3", ""), ("3", ""), ("None", "q")]


def test_accepted_rows_are_unchanged(spark):
    docs = spark.createDataFrame([(1, "nice words", None), (2, "zonker", 3)], "doc_id long, text string, score int")
    model = toxicity.Model(toxicity.Lexicon(["zonker"], []), np.array([-2.0, 5, 0, 0, 0, 0, 0]))
    assert [tuple(r) for r in toxicity.accepted(docs, model).collect()] == [(1, "nice words", None)]
