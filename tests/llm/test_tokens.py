import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing
from tidemark.llm.q_tokens import op1_best_fit_packing, op5_bpe_round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
random.seed(5)
TEXTS = [
    None, "", "  leading and trailing \n\n", "it's <|endoftext|> we'll", "x" * 30000, "ab" * 5000 + " tail", " " * 9000 + "end",
    "".join(random.choices("étionbac", k=20000)), "words in a row. " * 3000, "same text", "same text", "日本語 😀 \x85\x1c z" * 50,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string").write.parquet(f"{at}/documents.parquet")
    return at


def test_round_trip_equals_the_library(spark, folder, library):
    got = {r.doc_id: r for r in op5_bpe_round_trip(spark, folder).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_tree_concatenation_of_random_pieces(library):
    c = bpe.Codec(PATH)
    for _ in range(40):
        piece = "".join(random.choices(random.choice(["abc", "etaoinshrd", "éèab", "=-"]), k=random.randint(1500, 6000)))
        assert c.tree(piece.encode()) == library.encode(piece, add_special_tokens=False).ids


def test_tree_concatenation_of_whole_texts(library, monkeypatch):
    c = bpe.Codec(PATH)
    words = ["it's", "we'll", "'s", "''re", "don't", "x1y2", "A_b", "é\u0301", "😀", "日本", "...", "<|endoftext|>", "<|", "12", " ", "\n", "\n\n ", "\t", "\x85", "\u00a0", "--", "word", "Word"]
    for part in (1, 2, 3, 7, 50):
        monkeypatch.setattr(bpe, "PART", part)
        monkeypatch.setattr(bpe, "LONG", 200)
        for _ in range(150):
            text = "".join(random.choice(words) + random.choice(["", "", " "]) for _ in range(random.randint(1, 60)))
            assert c.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, (part, text)
            cuts = sorted({0, len(text), *(random.randint(0, len(text)) for _ in range(4))})
            parts = [c.encode(text[x:y]) for x, y in zip(cuts, cuts[1:])]
            assert c.joined(text, cuts, parts).tolist() == library.encode(text, add_special_tokens=False).ids, (cuts, text)
    assert c.joins > 1000


def test_long_texts_are_encoded_in_parts_by_rows(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "SPREAD", 300)
    rows = [(i, t, i, i, i) for i, t in enumerate(TEXTS)] + [(99, "a <|endoftext|>" * 200, 1, 1, 1)]
    df = spark.createDataFrame(rows, "row_ long, text string, at_ long, part_ long, ids_ long").repartition(2)
    got = {r.row_: r for r in bpe.digests(df, PATH).collect()}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert len(got) == len(rows)


def test_ordinary_documents_take_the_tree(library):
    c = bpe.Codec(PATH)
    text = " ".join(random.choices(["plain", "words", "and", "more,", "don't"], k=3000))
    assert c.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert c.joins >= 7


def test_encode_then_decode(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert [r.decoded for r in rows] == [r.text or "" for r in rows]


def test_packing_places_every_piece_once(spark, folder, library):
    rows = op1_best_fit_packing(spark, folder).collect()
    by, fill = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
        assert all(r.length == 1024 for r in own[1:])
        for r in own:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for places in fill.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024


def test_tree_of_groups_comes_near_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 40)
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1025, 3000).tolist()
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, length long")
    rows = packing.pack(items, 1024).collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in fill.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    assert len(fill) <= -(-sum(sizes) // 1024) * 1.1
    groups = {}
    for r in rows:
        groups.setdefault(r.sequence_id, 0)
    assert packing.pack(items.limit(0), 1024).count() == 0


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300)
    bin_of, offset, fills = packing.best_fit(sizes, 100)
    free = []
    for k in np.argsort(-sizes, kind="stable"):
        fits = [f for f in free if f >= sizes[k]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - sizes[k])
        else:
            free.append(100 - sizes[k])
    assert len(fills) == len(free) and sorted(100 - fills) == sorted(free)


def test_sequences_hold_the_ids(spark, folder):
    placed = packing.pack_documents(spark.read.parquet(f"{folder}/documents.parquet"), PATH, with_ids=True)
    total = {r.sequence_id: r.n for r in placed.groupBy("sequence_id").sum("length").toDF("sequence_id", "n").collect()}
    assert {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(placed).collect()} == total


def test_packing_of_columns_that_clash(spark):
    rows = [(i, 100 + i % 7, 1, 2, 3, 4, 5, 6) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, length long, at long, bin long, fill long, up long, __uid long, bin_ long")
    got = packing.pack(df, 1024).collect()
    assert sorted(r.id for r in got) == list(range(500)) and {(r.at, r.bin, r.fill, r.up, r["__uid"], r.bin_) for r in got} == {(1, 2, 3, 4, 5, 6)}
    assert packing.pieces(spark.createDataFrame([(1, "a")], "piece long, text string"), PATH, key="piece").first()[0] == 1


def test_packing_through_several_levels_of_full_groups(spark):
    n = packing.ITEMS * packing.FAN + 5000  # more than FAN groups of ITEMS, so three levels
    df = spark.range(n).selectExpr("id", "1 + pmod(xxhash64(id), 700) as length")
    got = packing.pack(df, 1024)
    bins = got.groupBy("sequence_id").agg({"length": "sum"}).toPandas()["sum(length)"]
    assert got.count() == n and bins.max() <= 1024
    assert len(bins) <= 1.01 * -(-int(bins.sum()) // 1024)
