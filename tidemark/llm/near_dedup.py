"""Near-duplicate documents by SetSketch registers.

Each distinct word sequence is a class. Its set of shingles is sketched by M registers; a register is the minimum of an
exponential hash over the set, on an exponentially spaced scale, truncated to 16 bits. Sketches of parts merge by the
maximum. Two sets agree in a register with a probability of at least about their Jaccard similarity, so BANDS bands of
ROWS registers miss a pair at 0.75 with (1 - 0.75^ROWS)^BANDS, below one in a million.

Links are confirmed on full sets. First each class is compared with the one of the smallest members of its buckets that
looks most alike, then with the one that looks most alike in a few bands; both are as many comparisons as there are
classes, and join up most of a large group. Last, in every bucket, all pairs of classes that are still in different
components and whose registers make a similarity of LOOKS or more likely are compared. For this a bucket is split into
blocks of bounded size; two blocks of the component that most of the bucket is in never meet. How alike classes look is
judged from FINE registers of one byte on a coarser scale, made only for classes that share a bucket; LOOKS is five
standard errors below 0.75. Only distinct texts are compared; copies belong to their class.

Null or empty text: an empty set, linked with nothing. Null key: counts as larger than any other key. Repeated keys:
every row has its own class; the component's smallest key is that of any of its rows. Empty table: no rows. Very long
text: its words and shingles are one row of one task; sketches and registers are as small as any other's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, release, renamed, settings, with_fields
from tidemark.llm.components import connected
from tidemark.llm.shingles import identity, mixed, numbers, shingle_set, words_of
from tidemark.shipping import ship

ROWS, BANDS = 4, 40
M = ROWS * BANDS
#: Base of the scale, rate of the exponentials, and the largest register.
B, A, Q = 1.001, 20.0, 65534
FINE, FINE_B, FINE_Q, LOOKS = 768, 1.1, 254, 0.67
BLOCK, SQUARE, FIRST_BANDS = 64, 16, 4
FACTORS, OFFSETS = numbers(FINE, 1) | np.uint64(1), numbers(FINE, 2)
CHUNK = 1 << 15


def minima(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """For each non-empty set and hash function the least 64-bit hash."""
    out = np.empty((len(sets), m), "u8")
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        one = end == at + 1
        room = np.empty_like(flat)
        for i in range(m):
            np.bitwise_xor(flat, OFFSETS[i], out=room)
            np.multiply(room, FACTORS[i], out=room)
            out[at:end, i] = room.min() if one else np.minimum.reduceat(room, starts)
        at = end
    return out


def registers(least: np.ndarray, b: float = B, q: int = Q) -> np.ndarray:
    """Registers of the minima: 1 - log_b of the exponential that the minimum stands for, cut to 0..q+1."""
    u = (least.astype("f8") + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / A
    return np.clip(np.floor(1 - np.log(x) / math.log(b)), 0, q + 1).astype("<u2" if q > 254 else "u1")


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    return registers(minima(sets)) if sets else np.zeros((0, M), "<u2")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time: sets and registers of a whole batch of texts would fill a worker's memory."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


GRID = np.linspace(0, 1, 201)


def likelihood_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float = FINE_B) -> np.ndarray:
    """The Jaccard similarity that makes the counts of larger, smaller and equal registers most likely, for sets of known sizes."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / math.log(base)
    j = np.minimum(GRID[None, :], np.minimum(u / v, v / u))
    pu, pd = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    total = up[:, None] * np.log(pu + tiny) + down[:, None] * np.log(pd + tiny) + same[:, None] * np.log(np.maximum(1 - pu - pd, tiny))
    return np.take_along_axis(j, total.argmax(1)[:, None], 1)[:, 0]


def _sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, ident, regs per row."""
    kind = with_fields(docs.select(key).schema, "n long, ident binary, regs binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, sets, where = [], [], {}
            for t in b.column(1).to_pylist():
                words = words_of(t)
                ids.append(identity(words))
                if words and ids[-1] not in where:
                    where[ids[-1]] = len(sets)
                    sets.append(shingle_set(words))
            regs = sketch(sets)
            n = [len(sets[where[i]]) if i else 0 for i in ids]
            raw = [regs[where[i]].tobytes() if i else None for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, "int64"), pa.array(ids, "binary"), pa.array(raw, "binary")], names=[f.name for f in kind])

    return docs.select(key, text).mapInArrow(work, kind)


def _estimated(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs a, b that look alike, with the estimate."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("fine").alias(f"r{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
            ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), "u1").reshape(-1, FINE) for c in ("ra", "rb"))
            looks = likelihood_estimate(ra, rb, na, nb)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(looks)], names=["a", "b", "looks"]).filter(pa.array(looks >= LOOKS))

    return both.mapInArrow(work, "a long, b long, looks double")


def _open_pairs(shared: DataFrame, labels: DataFrame, texts: DataFrame, best_only: bool) -> DataFrame:
    """Pairs a, b (with looks) of a bucket that are in different components and look alike, each from one bucket only.

    best_only: for each class of a pair of blocks just the partner that looks most alike.
    """
    labelled = shared.select("bucket", "band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # A bucket's main component takes the low blocks; a bucket of one component is done.
    each = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    sizes = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("size")).filter("labels > 1").drop("labels")
    # A table of its own, so that Spark can split the join of a bucket that many classes share.
    sizes = materialize(sizes, "sizes")
    placed = labelled.join(sizes, "bucket").withColumn("many", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), "many") + F.when(F.col("label") == F.col("main"), 0).otherwise(F.col("many")))
    member = F.struct("node", "label", "n", "fine", "bands")
    blocks = placed.join(texts.select("node", "n", "fine", "bands"), "node").groupBy("bucket", "band", "many", "block").agg(F.collect_list(member).alias("m"))
    # Blocks meet in squares of SQUARE by SQUARE, so that a bucket with many of them is many keys.
    last = F.floor((2 * F.col("many") - 1) / SQUARE)
    a = blocks.filter("block >= many").select("bucket", "band", "many", F.col("block").alias("i"), F.col("m").alias("ma"), F.floor(F.col("block") / SQUARE).alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("v"))
    b = blocks.select("bucket", F.col("block").alias("j"), F.col("m").alias("mb"), F.floor(F.col("block") / SQUARE).alias("v"), F.explode(F.sequence(F.floor(F.col("many") / SQUARE), last)).alias("u"))
    both = a.join(b, ["bucket", "u", "v"]).filter("j < many or i <= j").select("band", (F.col("i") == F.col("j")).alias("same"), "ma", "mb")

    def side(members: list[dict]) -> tuple[np.ndarray, ...]:
        fine = np.frombuffer(b"".join(m["fine"] for m in members), "u1").reshape(-1, FINE)
        bands = np.frombuffer(b"".join(m["bands"] for m in members), "<u4").reshape(-1, BANDS)
        node, label, n = (np.array([m[c] for m in members]) for c in ("node", "label", "n"))
        return node, label, n, fine, bands

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            out = [], [], []
            for r in batch.to_pylist():
                node_a, label_a, n_a, fine_a, bands_a = side(r["ma"])
                node_b, label_b, n_b, fine_b, bands_b = side(r["mb"])
                ok = (label_a[:, None] != label_b[None]) & (100 * np.minimum(n_a[:, None], n_b[None]) >= 75 * np.maximum(n_a[:, None], n_b[None]))
                if r["same"]:
                    ok &= node_a[:, None] < node_b[None]
                for k in range(r["band"]):
                    ok &= bands_a[:, None, k] != bands_b[None, :, k]
                x, y = np.nonzero(ok)
                looks = np.concatenate([likelihood_estimate(fine_a[x[k : k + 500]], fine_b[y[k : k + 500]], n_a[x[k : k + 500]], n_b[y[k : k + 500]]) for k in range(0, len(x), 500)] or [np.zeros(0)])
                good = looks >= LOOKS
                u, v, looks = x[good], y[good], looks[good]
                if best_only and len(u):
                    order = np.argsort(-looks, kind="stable")
                    _, first = np.unique(u[order], return_index=True)
                    _, other = np.unique(v[order], return_index=True)
                    pick = order[np.union1d(first, other)]
                    u, v, looks = u[pick], v[pick], looks[pick]
                for c, values in zip(out, (node_a[u], node_b[v], looks)):
                    c.extend(values.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], "int64"), pa.array(out[1], "int64"), pa.array(out[2], "float64")], names=["a", "b", "looks"])

    return both.mapInArrow(work, "a long, b long, looks double")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets have 100 * intersection >= 75 * union."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in slices(batches):
            good = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if last[0] != tb:
                    last = tb, shingle_set(words_of(tb))
                a, b = shingle_set(words_of(ta)), last[1]
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * common >= 75 * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, "bool"))

    return both.mapInArrow(work, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node, n, text, fine, bands of the wanted classes (node, ident, first): the row's text must be of the class, as keys may repeat."""
    # The length test is always true; Spark makes a Bloom filter only of a side with some condition.
    wanted = wanted.filter(F.length("ident") > 1).select("node", "ident", F.col("first").alias("__k2"))
    same = F.col("__k") == F.col("__k2")
    if wanted.filter("__k2 is null").limit(1).count():
        same = F.col("__k").eqNullSafe(F.col("__k2"))
    found = docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).join(wanted, same).select("node", "ident", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(k, t, w) for k, t, i in zip(*(b.column(c).to_pylist() for c in ("node", "text", "ident"))) if identity(w := words_of(t)) == i]
            sets = [shingle_set(w) for _, _, w in rows]
            least = minima(sets, FINE) if sets else np.zeros((0, FINE), "u8")
            fine = [x.tobytes() for x in registers(least, FINE_B, FINE_Q)]
            # 32 bits of each band's key are enough to tell the first band that two classes share.
            keys = np.ascontiguousarray(registers(least[:, :M])).view("<u8")
            bands = [x.tobytes() for x in (mixed(keys) >> np.uint64(32)).astype("<u4")]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], "int64"), pa.array(map(len, sets), "int64"), pa.array([r[1] for r in rows], "string"), pa.array(fine, "binary"), pa.array(bands, "binary"),
            ], names=["node", "n", "text", "fine", "bands"])

    # The wanted keys make a Bloom filter of bounded size, so that the scan passes on little else.
    bloom = "spark.sql.optimizer.runtime.bloomFilter"
    with settings(docs.sparkSession, {f"{bloom}.enabled": "true", f"{bloom}.applicationSideScanSizeThreshold": "1", f"{bloom}.creationSideThreshold": "1g"}):
        return materialize(found.mapInArrow(work, "node long, n long, text string, fine binary, bands binary").dropDuplicates(["node"]), "texts")


def _best(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For each a the pair that looks most alike, if it is a link."""
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("looks", "b")).alias("b"))
    return materialize(_confirmed(best, texts), "links")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key that can be reached), kept (key = component_id)."""
    ship(docs.sparkSession)
    # Names of our own, as a key may be called what we call something else.
    docs, named_key, key, text = docs.select(F.col(key).alias("k_"), F.col(text).alias("t_")), key, "k_", "t_"
    rows = materialize(_sketched(docs, key, text), "rows")
    classes = rows.filter("ident is not null").groupBy("ident").agg(F.min(key).alias("first"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("regs", i * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("bucket")))
    members = classes.select("node", F.inline(keys))
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    shared = materialize(members.join(hubs, "bucket"), "shared")
    texts = _texts(docs, classes.join(shared.select("node").distinct(), "node", "left_semi"), key, text)

    release(docs.sparkSession)

    stars = shared.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = _best(_estimated(stars, texts), texts)
    labels = connected(links)
    # Rows of blocks are large, so few of them go to Python at a time.
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}):
        near = materialize(_open_pairs(shared.filter(F.col("band") < FIRST_BANDS), labels, texts, True), "near")
    release(docs.sparkSession)
    turned = near.select(F.col("b").alias("a"), F.col("a").alias("b"), "looks")
    links = links.unionByName(_best(near.unionByName(turned), texts))
    labels = connected(links)
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}):
        rest = materialize(_open_pairs(shared, labels, texts, False), "rest")
    release(docs.sparkSession)
    links = links.unionByName(materialize(_confirmed(rest, texts), "links"))
    labels = materialize(connected(links), "labels")
    release(docs.sparkSession)

    named = classes.select("ident", "node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = materialize(named.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    ends = named.join(least, "label").select("ident", "component_id")
    found = rows.select(key, F.col("n").alias("n_shingles"), "ident").join(ends, "ident", "left")
    component = F.when(F.col("ident").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return found.select(F.col(key).alias(named_key), "n_shingles", component.alias("component_id"), F.coalesce(F.col(key) == component, component.isNull()).alias("kept"))


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that are not kept: one row of each component stays, and all rows without words.

    If a component's smallest key is that of several rows, one row of each of their texts stays.
    """
    docs, back = renamed(docs)
    key, text = back.here(key), back.here(text)
    found = components(docs, key, text).select(F.col(key).alias("__key"), "kept", F.col("n_shingles").alias("__n"))
    keep = found.filter("kept").groupBy("__key").agg(F.max("__n").alias("__n"), F.count(F.lit(1)).alias("__rows"))
    kept = docs.join(keep, F.col(key).eqNullSafe(F.col("__key")) if keep.filter("__key is null").limit(1).count() else F.col(key) == F.col("__key"))
    first = kept.filter("__rows > 1 and __n > 0").dropDuplicates(["__key", text])
    return back(kept.filter("not (__rows > 1 and __n > 0)").unionByName(first))
