import random

from tidemark.llm import licenses as lic
from tidemark.llm.q_licenses import op2_license_scan

random.seed(3)
FILLER = [f"filler{i}" for i in range(200)]


def made():
    words = random.choices(FILLER, k=random.randint(0, 120))
    for _ in range(random.choice([0, 1, 1, 2])):
        t = random.choice(list(lic.TEMPLATES.values())).split()
        if random.random() < 0.4:
            t[random.randrange(len(t))] = "changed"
        at = random.randint(0, len(words))
        words[at:at] = t
    return " ".join(words)


TEXTS = [None, "", "MIT", "(Released under the MIT License.)", "Released -- UNDER\tthe mit license"] + [made() for _ in range(250)] + ["pad " * 30000 + lic.TEMPLATES["MIT grant"]]


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def plain(text):
    own = shingles(lic.words_of(text or ""))
    out = {}
    for name, t in lic.TEMPLATES.items():
        s = set(shingles(lic.words_of(t)))
        at = [i for i, x in enumerate(own) if x in s]
        if len(s & set(own)) / len(s) >= 0.75:
            out[name] = (len(s), len(s & set(own)), at[0], at[-1] + 5)
    return out


def test_matches_equal_a_full_search(spark, tmp_path):
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, template string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in op2_license_scan(spark, str(tmp_path)).collect():
        # A text that begins with signs has an empty piece in front.
        got.setdefault(r.doc_id, {})[r.template] = (r.n_shingles, r.n_found, r.start_word - (r.doc_id == 3), r.end_word - (r.doc_id == 3))
    assert got == {i: p for i, t in enumerate(TEXTS) if (p := plain(t))}


def test_null_keys_repeated_rows_and_empty(spark):
    rows = [(None, "so: released under the MIT license"), (1, "released under the MIT license"), (1, "released under the MIT license"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.template) for r in lic.scan(docs).collect()) == [("1", "MIT"), ("None", "MIT")]
    assert lic.scan(docs.limit(0)).count() == 0
    assert lic.scan(docs, {}).count() == 0


def test_a_short_template_at_the_very_beginning(spark):
    rows = [(i, f"Released under the MIT License {' '.join(f'w{i}x{j}' for j in range(9))}") for i in range(4000)]
    got = lic.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), {"MIT": lic.TEMPLATES["MIT"]})
    assert got.count() == len(rows)
