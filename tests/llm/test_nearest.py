import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import nearest
from tidemark.llm.q_nearest import op10_nearest_neighbours


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, block int")


def test_recall_order_and_scores(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = op10_nearest_neighbours(spark, str(tmp_path)).toPandas()
    d = x.astype("f8")
    hits = 0
    for q, found in rows.groupby("query_id"):
        found = found.sort_values("rank")
        s = d @ d[q]
        assert found["rank"].tolist() == list(range(1, 21)) and q not in found.vec_id.values
        assert np.allclose(found.score, s[found.vec_id.values], rtol=0, atol=1e-12)
        assert sorted(zip(-found.score, found.vec_id)) == list(zip(-found.score, found.vec_id))
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20]) & set(found.vec_id))
    assert rows.query_id.nunique() == 150 and hits / (150 * 20) >= 0.9


def test_copies_ties_and_vectors_that_take_no_part(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(100)] + [(100 + i, [2.0 + i, 0.0], 1) for i in range(3)]
    rows += [(200, None, 1), (220, [0.0, 0.0], 1), (240, [1.0, None], 1), (260, [math.nan, 1.0], 1), (280, [1.0, 2.0, 3.0], 1), (None, [5.0, 5.0], 1), (20, [1.0, 2.0], 2)]
    got = nearest.search(frame(spark, rows, "double"), F.col("id") % 20 == 0, k=5).toPandas()
    assert set(got.query_id) == {0, 20, 40, 60, 80, 100}
    for q, found in got[got.query_id != 20].groupby("query_id"):
        v = np.array([1.0, 2.0]) if q < 100 else np.array([2.0, 0.0])
        best = sorted((-float(np.dot(v, x)), i) for i, x, _ in rows if i is not None and i < 200 and i != q)[:5]
        assert list(zip(-found.sort_values("rank").score, found.sort_values("rank").vec_id)) == best
    few = nearest.search(frame(spark, rows[:2], "double"), F.col("id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]
    assert nearest.search(frame(spark, []), F.col("id") == 0).count() == 0


def test_fewer_curves_do_on_vectors_with_structure(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 20_000)] + 0.15 * rng.normal(size=(20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = nearest.search(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], "double").repartition(8), F.col("id") % 500 == 0, k=10, n_curves=16, share=0.03).toPandas()
    hits = 0
    for q, found in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:10]) & set(found.vec_id))
    assert hits / 400 >= 0.9


def test_hilbert_curve_visits_neighbours_in_turn():
    for d, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        order = np.argsort(nearest.hilbert(cells, bits))
        steps = np.abs(np.diff(cells[order], axis=0)).sum(1)
        assert (steps == 1).all() and len(set(nearest.hilbert(cells, bits))) == len(cells)
