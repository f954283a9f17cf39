"""Numbers put back in order before anything judges them: a bounded wait for the events that are still missing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shipping import ship

HELD, WINDOW_US = 1024, 2_000_000
#: Arrivals of a publisher that are put in order together; what is still held at the end of a block goes out.
BLOCK = 100_000


class Holdback:
    """One publisher's buffer. Events ahead of the next number wait for it, for a window or until too many are held.

    The first event of an epoch sets the next number. An event of another epoch, later or earlier, ends the wait.
    Late numbers and repeats pass: judging them is not done here. Items are whatever the caller wants back.
    """

    def __init__(self, window_us: int = WINDOW_US, most: int = HELD) -> None:
        self.window_us, self.most = window_us, most
        self.epoch = self.next = self.oldest = None
        self.held: dict[int, list] = {}

    def offer(self, epoch: int, seq: int, at_us: int, item: object) -> list:
        """What may be judged now, in order."""
        if self.window_us <= 0:
            return [item]
        out = self.expire(at_us)
        if epoch != self.epoch:
            out += self.drain()
            self.epoch, self.next = epoch, seq + 1
            return [*out, item]
        if seq < self.next:
            return [*out, item]
        if seq > self.next:
            if not self.held:
                self.oldest = at_us
            self.held.setdefault(seq, []).append(item)
            return out + self.drain() if len(self.held) >= self.most else out
        out.append(item)
        self.next += 1
        while self.next in self.held:
            out += self.held.pop(self.next)
            self.next += 1
        return out

    def expire(self, now_us: int) -> list:
        """Everything held, once the oldest of it has waited for the window."""
        return self.drain() if self.held and now_us - self.oldest >= self.window_us else []

    def drain(self) -> list:
        if not self.held:
            return []
        out = [x for seq in sorted(self.held) for x in self.held[seq]]
        self.next, self.held, self.oldest = max(self.next, max(self.held) + 1), {}, None
        return out


def reordered(events: DataFrame, window_us: int = WINDOW_US, most: int = HELD, block: int = BLOCK) -> DataFrame:
    """events (publisher, epoch, seq, arrival, observed_at) with `received`, the order they came in, and arrival, the order they are judged in.

    The events of a publisher take each other's places: the one released first the first of them, so arrivals stay unique.
    Columns are epochs, numbers, texts and times; whole numbers other than those named must not be null, but ttl, delta and user_id. A publisher may send a third of
    all events: its stream is cut into blocks of arrivals, each with a buffer of its own that is empty at its end, so a wait
    across the border of two blocks ends there. It begins with the epoch and the next number that the blocks before lead to.
    events are read twice.
    """
    rows = events.withColumn("received", F.col("arrival"))
    if window_us <= 0:
        return rows
    ship(events.sparkSession)
    rows = rows.withColumns({"__at": F.unix_micros(F.col("observed_at").cast("timestamp")), "__b": F.floor(F.col("arrival") / block)})
    rows = rows.join(_carried(rows), ["publisher", "__b"])

    def work(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("arrival", kind="stable")
        buffer, order, came = Holdback(window_us, most), [], own.arrival.tolist()
        if own["__going"].iat[0]:
            buffer.epoch, buffer.next = int(own["__epoch"].iat[0]), int(own["__high"].iat[0]) + 1
        for i, (epoch, seq, at) in enumerate(zip(own.epoch.tolist(), own.seq.tolist(), own["__at"].tolist())):
            order += buffer.offer(epoch, seq, at, i)
        order += buffer.drain()
        return own.iloc[order].assign(arrival=came)

    # As text through pandas, which has no nulls among whole numbers.
    kinds = {f.name: f.dataType for f in rows.schema}
    as_text = [c for c, k in kinds.items() if k.typeName() not in ("string", "boolean", "long") or c in ("ttl", "delta", "user_id")]
    as_text = [c for c in as_text if not c.startswith("__")]
    sent = rows.withColumns({c: F.col(c).cast("string") for c in as_text})
    done = sent.groupBy("publisher", "__b").applyInPandas(work, sent.schema)
    return done.withColumns({c: F.col(c).cast(kinds[c]) for c in as_text}).drop("__at", "__b", "__going", "__epoch", "__high")


def _carried(rows: DataFrame) -> DataFrame:
    """publisher, __b, and what a buffer knows that has let go of all before this block: __epoch, __high (the highest number since that epoch's last beginning), if it is __going at all."""
    whole = Window.partitionBy("publisher", "__b")
    ends = rows.select("publisher", "__b", "epoch", "seq", "arrival").withColumn("__epoch", F.max_by("epoch", "arrival").over(whole))
    ends = ends.withColumn("__turn", F.max(F.when(F.col("epoch") != F.col("__epoch"), F.col("arrival"))).over(whole))
    ends = ends.groupBy("publisher", "__b", "__epoch", "__turn").agg(F.max(F.when(F.col("__turn").isNull() | (F.col("arrival") > F.col("__turn")), F.col("seq"))).alias("__high"))
    # One row for each block from here on. A block of the same epoch throughout goes on with what came before.
    by_block = Window.partitionBy("publisher").orderBy("__b")
    begins = F.col("__turn").isNotNull() | ~F.col("__epoch").eqNullSafe(F.lag("__epoch").over(by_block))
    ends = ends.withColumn("__begins", begins.cast("int")).withColumn("__run", F.sum("__begins").over(by_block))
    ends = ends.withColumn("__high", F.max("__high").over(Window.partitionBy("publisher", "__run").orderBy("__b")))
    last = F.lag(F.struct("__epoch", "__high")).over(by_block)
    none = F.lit(0).cast("long")  # pandas has no nulls among whole numbers
    return ends.withColumn("__l", last).select("publisher", "__b", F.col("__l").isNotNull().alias("__going"), F.coalesce("__l.__epoch", none).alias("__epoch"), F.coalesce("__l.__high", none).alias("__high"))
