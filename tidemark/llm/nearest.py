"""Approximate nearest neighbours by largest inner product, along shifted Hilbert curves.

CURVES times, vectors are projected to DIMS directions, shifted at random and put in the order of a Hilbert curve. The
directions of as many curves as fit are those of one random rotation, so that these curves look at different parts of a
vector. Each order is cut into blocks of equal numbers of rows by quantiles of a sample; a query meets the blocks around
its own place, SHARE of all rows. The best of a block are scored in double precision on the original vectors; the best of
all blocks of all curves are merged. Blocks have BLOCK rows at most, more rows make more blocks.

Work for a query is CURVES * SHARE = 0.6 of the rows, some of them met on several curves, so a full scan is less than
twice as dear; below 100 * LEAST rows it is even cheaper. On vectors without any structure a recall above 0.9 takes that
much; where vectors have some, fewer curves and a smaller share (parameters of search()) do.

Equal vectors are one candidate: it stands for its `k + 1` smallest ids, which are all that can be among the k nearest.
So a vector that a third of all rows have is one row of a block. If many different vectors share a place on a curve, its
blocks share them by hash and queries there meet all of these blocks.

Vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do those whose length is not the most
frequent one (ties: the smaller). Null ids take no part. Repeated ids: each row is a vector of its own; a query's own id
is left out. No valid vectors: no rows. SAMPLE bounds the rows used to place cuts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.shipping import ship

CURVES, DIMS, BITS, SHARE, SAMPLE = 40, 8, 4, 0.015, 20_000
#: The least and most rows of a block; a query meets its own block and one on either side, or more where that is less than its share.
LEAST, BLOCK = 64, 8192


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (n x d, `bits` bits each), by the transpose form of the curve."""
    x = cells.astype("i8").copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, "i8")
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    place = np.zeros(n, "i8")
    for bit in reversed(range(bits)):
        for i in range(d):
            place = place << 1 | (x[:, i] >> bit) & 1
    return place


class Curves:
    """The projections and shifts, with the cuts between the blocks of each curve."""

    def __init__(self, sample: np.ndarray, rows: int, curves: int = CURVES, share: float = SHARE, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.dims = min(DIMS, size)
        self.count = max(1, min(math.ceil(3 / share), rows // LEAST), -(-rows // BLOCK))
        self.reach = max(1, int(np.ceil((share * self.count - 1) / 2 - 1e-9)))
        self.ways, self.low, self.width, self.cuts = [], [], [], []
        for c in range(curves):
            part = c % (size // self.dims)
            if part == 0:
                turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
            way = turn[:, part * self.dims : (part + 1) * self.dims]
            y = sample @ way
            spread = np.maximum(y.std(0), 1e-12)
            self.ways.append(way)
            self.low.append(y.mean(0) - (4 + rng.uniform(-0.5, 0.5, self.dims)) * spread)
            self.width.append(8 * spread)
            self.cuts.append(np.zeros(0, "i8"))
            places = np.sort(self.places(sample, len(self.ways) - 1))
            self.cuts[-1] = places[np.arange(1, self.count) * len(places) // self.count]

    def places(self, x: np.ndarray, c: int) -> np.ndarray:
        unit = (x @ self.ways[c] - self.low[c]) / self.width[c]
        return hilbert(np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1).astype("i8"), BITS)

    def blocks(self, x: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last block of each row's place; more than one only where cuts coincide."""
        p = self.places(x, c)
        return np.searchsorted(self.cuts[c], p, "left"), np.searchsorted(self.cuts[c], p, "right")


def _valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: the vectors that take part, as little-endian doubles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or not x or None in x:
                    continue
                v = np.asarray(x, "<f8") + 0.0
                if np.isfinite(v).all() and v.any():
                    ids.append(i), found.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, "int64"), pa.array(found, "binary")], names=["id", "v"])

    return vectors.select(F.col(key).cast("long"), vector).mapInArrow(work, "id long, v binary")


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", n_curves: int = CURVES, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which the condition on `id` holds, its k nearest other rows."""
    spark = vectors.sparkSession
    ship(spark)
    valid = materialize(_valid(vectors, key, vector), "valid")
    length = valid.groupBy(F.length("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = length[0] // 8 if length else 1
    valid = valid.filter(F.length("v") == 8 * size)
    asked = valid.filter(is_query)
    # Equal vectors become one row with their k + 1 smallest ids; ranks are limited before the shuffle, too.
    ranked = valid.withColumn("__n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("__n") <= k + 1)
    distinct = ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("vid"))
    distinct = distinct.join(asked.groupBy("v").agg(F.lit(True).alias("asked")), "v", "left")
    distinct = materialize(distinct.select("vid", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "distinct")
    rows = distinct.count()
    picked = distinct.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    curves = spark.sparkContext.broadcast(Curves(np.frombuffer(b"".join(picked), "<f8").reshape(-1, size), rows, n_curves, share))
    narrow = vectors.schema[vector].dataType.elementType.typeName() == "float"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = curves.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                x = np.frombuffer(b"".join(b.column("v").to_pylist()), "<f8").reshape(-1, size)
                vid, asked = b.column("vid").to_numpy(), b.column("asked").to_numpy(zero_copy_only=False)
                raw = pa.array([v.tobytes() for v in (x.astype("<f4") if narrow else x)], "binary")
                for c in range(n_curves):
                    first, last = at.blocks(x, c)
                    block = first + (vid * 2654435761 + c) % (1 << 31) % (last - first + 1)
                    row, role, to = [np.arange(len(x))], [np.zeros(len(x), "i4")], [block]
                    q = np.flatnonzero(asked)
                    low, high = np.maximum(first[q] - at.reach, 0), np.minimum(last[q] + at.reach, at.count - 1)
                    many = high - low + 1
                    row.append(np.repeat(q, many)), role.append(np.ones(many.sum(), "i4"))
                    to.append(np.concatenate([np.arange(l, h + 1) for l, h in zip(low, high)] or [np.zeros(0, "i8")]))
                    take = pa.array(np.concatenate(row))
                    n = len(take)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, "i4")), pa.array(np.concatenate(to).astype("i4")), pa.array(np.concatenate(role)), b.column("vid").take(take), raw.take(take), b.column("ids").take(take)], names=["curve", "block", "role", "vid", "x", "ids"])

    dealt = distinct.mapInArrow(deal, "curve int, block int, role int, vid long, x binary, ids array<bigint>")
    kind = "<f4" if narrow else "<f8"

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        q, c = rows[rows.role == 1], rows[rows.role == 0]
        if not len(q) or not len(c):
            return pd.DataFrame({"vid": pd.Series([], dtype="int64"), "best": pd.Series([], dtype="object")})
        a, b = (np.frombuffer(b"".join(r.x), kind).reshape(-1, size).astype("f8") for r in (q, c))
        ids = c.ids.to_list()
        out = []
        for start in range(0, len(a), 256):
            part = a[start : start + 256]
            rough = part @ b.T
            m = min(k + 2, len(b))
            top = np.argpartition(-rough, m - 1, axis=1)[:, :m]
            # All that tie with the last are kept, so that ids decide.
            edge = np.take_along_axis(rough, top, 1).min(1)
            for i in range(len(part)):
                near = np.flatnonzero(rough[i] >= edge[i] - 1e-9 * (1 + abs(edge[i])))
                exact = (part[i] * b[near]).sum(1)
                best = sorted((-s, x) for s, j in zip(exact.tolist(), near.tolist()) for x in ids[j])[: k + 1]
                out.append([{"s": s, "id": x} for s, x in best])
        return pd.DataFrame({"vid": q.vid.to_numpy(), "best": pd.Series(out, dtype="object")})

    found = dealt.groupBy("curve", "block").applyInPandas(meet, "vid long, best array<struct<s:double,id:bigint>>")
    # Met on several curves, a row has the same score each time, so its entries stand side by side.
    merged = found.groupBy("vid").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("a"))
    merged = merged.select("vid", F.slice(F.expr("filter(a, (x, i) -> i = 0 or a[i - 1].id <> x.id)"), 1, k + 1).alias("best"))
    own = asked.join(distinct.filter("asked").select("v", "vid"), "v").select("id", "vid").join(merged, "vid")
    near = own.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.expr("filter(best, x -> x.id <> id)"), 1, k)).alias("pos", "x"))
    return near.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
