"""Best-fit packing of token pieces into sequences of bounded length.

Hierarchical residual packing. Items are dealt by a hash into groups of bounded size; each group packs best-fit, longest
first, and closes its bins. Bins that a later merge could still use climb a tree: groups of FAN children take them as
items and pack them best-fit again, up to one root. Within a node no two bins fit together when it is done, so at most
one is half full or less, and each merge further up needs such a bin on one side; a parent sees at most FAN of them. The
CARRY emptiest bins of a node (more than FAN) are therefore all that can help, and every node stays bounded.

Null text: read as the empty text (one end token). Null lengths count as 0 in pack(); lengths over the capacity are an
error there. Ties: any order, the same for the same input. Empty table: no rows. Repeated rows: packed once each. Very long
text: many pieces, made in one task, and packed like all others. Other columns of items pass through, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import codec
from tidemark.llm.common import materialize, renamed, union_all, with_fields
from tidemark.shipping import ship

#: Items in a group of the first level, children of a tree node, emptiest bins that a node hands up.
ITEMS, FAN, CARRY = 16384, 8, 64


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item its bin and offset, and the fill of each bin; the longest items go first, each into the fullest bin it fits."""
    bin_of, offset, fills = np.empty(len(sizes), "i8"), np.empty(len(sizes), "i8"), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit f is set if there is a bin with f free places
    for k in np.argsort(-sizes, kind="stable"):
        s = int(sizes[k])
        if fit := open_ >> s:
            free = s + (fit & -fit).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                open_ &= ~(1 << free)
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bin_of[k], offset[k] = b, fills[b]
        fills[b] += s
        if left := free - s:
            stacks[left].append(b)
            open_ |= 1 << left
    return bin_of, offset, np.array(fills, "i8")


def _level(items: DataFrame, capacity: int, level: int, length: str) -> DataFrame:
    """items (with __node) plus bin_, at_, fill_, up_: the bin's id, the place in it, its fill, and whether it is handed up."""
    ship(items.sparkSession)
    kind = with_fields(items.schema, "bin_ long, at_ long, fill_ long, up_ boolean")

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__uid"], kind="stable").reset_index(drop=True)
        bin_of, at, fills = best_fit(rows[length].to_numpy(), capacity)
        up = np.zeros(len(fills), bool)
        up[np.argsort(fills, kind="stable")[:CARRY]] = True
        up &= fills < capacity
        return rows.assign(bin_=(level << 58) + (int(key[0]) << 26) + bin_of, at_=at, fill_=fills[bin_of], up_=up[bin_of])

    return items.groupBy("__node").applyInPandas(work, kind)


def pack(items: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """items plus sequence_id and offset, in as few sequences as hierarchical best fit finds."""
    items, back = renamed(items)
    length, columns = back.here(length), items.columns
    numbered = materialize(items.withColumn(length, F.coalesce(F.col(length).cast("long"), F.lit(0))).withColumn("__uid", F.monotonically_increasing_id()), "items")
    whole = numbered.filter(F.col(length) == capacity)
    rest = numbered.filter(F.col(length) != capacity)
    n = rest.count()
    nodes = max(1, -(-n // ITEMS))
    start = rest.withColumn("__node", F.pmod(F.xxhash64("__uid"), F.lit(nodes)))
    levels = [materialize(_level(start, capacity, 0, length), "level")]
    while nodes > 1:
        nodes = -(-nodes // FAN)
        bins = levels[-1].filter("up_ and at_ = 0").select(F.col("bin_").alias("__uid"), F.col("fill_").alias("length"), F.floor(F.col("__node") / FAN).alias("__node"))
        levels.append(materialize(_level(bins, capacity, len(levels), "length"), "level"))
    # From the root down: where each bin that was handed up ended.
    ends = None
    for made in levels[:0:-1]:
        here = made.select(F.col("__uid").alias("__child"), F.col("bin_").alias("__bin"), F.col("at_").alias("__at"), "up_")
        ends = _follow(here, ends).select("__child", F.col("__bin").alias("__end"), F.col("__at").alias("__more"))
    placed = _follow(levels[0].withColumnsRenamed({"bin_": "__bin", "at_": "__at"}), ends)
    return back(union_all([
        whole.select(*columns, (-1 - F.col("__uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")),
        placed.select(*columns, F.col("__bin").alias("sequence_id"), F.col("__at").alias("offset")),
    ]), "sequence_id", "offset")


def _follow(rows: DataFrame, ends: DataFrame | None) -> DataFrame:
    """rows with __bin and __at moved to where the bin ended, if it was handed up; the others take no part in the join."""
    if ends is None:
        return rows
    ends = ends.withColumnRenamed("__child", "__key")
    moved = rows.filter("up_").join(ends, F.col("__bin") == F.col("__key")).withColumn("__at", F.col("__at") + F.col("__more")).withColumn("__bin", F.col("__end"))
    return rows.filter("not up_").unionByName(moved.select(rows.columns))


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32 (and ids as little-endian unsigned 32-bit bytes).

    A document's ids are those of its text and one end id. Only documents over the capacity are cut; the first piece is the short one.
    """
    ship(docs.sparkSession)
    kind = with_fields(docs.select(F.col(key).alias("key_")).schema, "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(c.encode(t or ""), np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    data = ids[x:y].tobytes()
                    row.append(r), piece.append(p), start.append(x), length.append(y - x), crc.append(zlib.crc32(data))
                    raw += [data] * with_ids
            arrays = [b.column(0).take(pa.array(row, "int32")), pa.array(piece, "int32"), pa.array(start, "int64"), pa.array(length, "int64"), pa.array(crc, "int64")]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(raw, "binary")] * with_ids, names=[f.name for f in kind])

    return docs.select(key, text).mapInArrow(work, kind).withColumnRenamed("key_", key)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, path, capacity, end, key, text, with_ids), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pack_documents(..., with_ids=True); a sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    joined = F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))")
    return placed.groupBy("sequence_id").agg(parts).select("sequence_id", joined.alias("ids"))
