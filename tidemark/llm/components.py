"""Connected components of an undirected graph: forests of partitions, then alternating large and small stars.

Each partition first gives up all edges that close a circle within it. What is left goes through rounds of stars, each a
few joins, until nothing changes. Once there are LOCAL edges or fewer, one task finishes them: a bounded amount, where
rounds of joins would be all overhead. The labels are the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.shipping import ship

LOCAL = 200_000


class Forest:
    """Sets of joined nodes; the smallest of a set is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (y := self.up.setdefault(top, top)) != top:
            top = y
        while self.up[x] != top:
            self.up[x], x = top, self.up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition that do not close a circle."""
    f = Forest()
    for b in batches:
        yield b.filter(pa.array([f.join(x, y) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())], "bool"))


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f = Forest()
    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            f.join(x, y)
    nodes = list(f.up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, "int64"), pa.array([f.root(x) for x in nodes], "int64")], names=["node", "label"])


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return r[0], r[1]


def connected(edges: DataFrame) -> DataFrame:
    """node, label from edges a, b (bigint): label is the smallest node that can be reached. Nodes without edges are left out.

    No edges: no rows. Loops and repeated edges change nothing. A node with very many neighbours is a skewed key of a
    join only, and minima are aggregated before they are dealt.
    """
    ship(edges.sparkSession)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = materialize(edges.mapInArrow(_forest, "a long, b long"), "edges")
    mark = _mark(edges)
    while mark[0] > LOCAL:
        # Large star: larger neighbours of u move to the smallest node next to u.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours of u, and u, move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        edges = materialize(small.filter("a <> b").distinct(), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        return materialize(edges.coalesce(1).mapInArrow(_labels, "node long, label long"), "labels")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
