"""Stateful operators over the order of arrival: the sequence tracker and the reorder buffer of a stream.

State is one row for each publisher and is bounded: gaps by their largest number of intervals, held events by HELD.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.sequence import Tracker
from tidemark.shipping import ship

HELD, WINDOW_MS = 1024, 2000
TRACKER = "epoch long, high long, gaps array<array<long>>, truncated boolean, restarts long, incarnation long"
JUDGED = "publisher string, epoch long, seq long, arrival long, verdict string, incarnation long"
BUFFER = "epoch long, next long, held array<array<long>>"


def _sorted(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(frames))
    return rows.sort_values("arrival", kind="stable")


def track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    t = Tracker()
    if state.exists:
        t.epoch, t.high, gaps, t.truncated, t.restarts, t.incarnation = state.get
        t.gaps = [list(map(int, g)) for g in gaps]
    rows = _sorted(frames)
    found = [(t.observe(int(e), int(s)), t.incarnation) for e, s in zip(rows.epoch, rows.seq)]
    state.update((t.epoch, t.high, t.gaps, t.truncated, t.restarts, t.incarnation))
    yield rows.assign(publisher=key[0], verdict=[v for v, _ in found], incarnation=[i for _, i in found])[["publisher", "epoch", "seq", "arrival", "verdict", "incarnation"]]


def verdict_stream(events: DataFrame) -> DataFrame:
    """publisher, epoch, seq, arrival, verdict, incarnation of a stream of events; exact, restarts within an epoch included."""
    ship(events.sparkSession)
    return events.groupBy("publisher").applyInPandasWithState(track, JUDGED, TRACKER, "append", GroupStateTimeout.NoTimeout)


class Buffer:
    """Holds events that are ahead of the next number, and gives out what has become due."""

    def __init__(self, epoch: int | None = None, following: int | None = None, held: list[list[int]] | None = None) -> None:
        self.epoch, self.next, self.held = epoch, following, held or []

    def offer(self, epoch: int, seq: int, arrival: int) -> list[tuple[int, int, int]]:
        out = []
        if self.epoch is not None and epoch != self.epoch:
            out = self.drain()
            self.epoch = None
        if self.epoch is None:
            self.epoch, self.next = epoch, seq
        if seq < self.next:
            return [*out, (epoch, seq, arrival)]  # late: passed on as it is
        self.held.append([seq, arrival])
        self.held.sort()
        out += self._release()
        if len(self.held) > HELD:
            out += self.drain()
        return out

    def _release(self) -> list[tuple[int, int, int]]:
        out = []
        while self.held and self.held[0][0] <= self.next:
            seq, arrival = self.held.pop(0)
            out.append((self.epoch, seq, arrival))
            self.next = max(self.next, seq + 1)
        return out

    def drain(self) -> list[tuple[int, int, int]]:
        """Everything, in order: the window is over or too much is held."""
        out = [(self.epoch, s, a) for s, a in self.held]
        if self.held:
            self.next = self.held[-1][0] + 1
        self.held = []
        return out


def reorder(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    b = Buffer(*([state.get[0], state.get[1], [list(map(int, h)) for h in state.get[2]]] if state.exists else []))
    if state.hasTimedOut:
        out = b.drain()
    else:
        rows = _sorted(frames)
        out = [x for e, s, a in zip(rows.epoch, rows.seq, rows.arrival) for x in b.offer(int(e), int(s), int(a))]
    state.update((b.epoch, b.next, b.held))
    if b.held:
        state.setTimeoutDuration(WINDOW_MS)
    yield pd.DataFrame([(key[0], *x, i) for i, x in enumerate(out)], columns=["publisher", "epoch", "seq", "arrival", "place"])


def reorder_stream(events: DataFrame) -> DataFrame:
    """publisher, epoch, seq, arrival, place: a publisher's events, those ahead held until their predecessor, a full buffer or the window's end."""
    ship(events.sparkSession)
    return events.groupBy("publisher").applyInPandasWithState(reorder, "publisher string, epoch long, seq long, arrival long, place long", BUFFER, "append", GroupStateTimeout.ProcessingTimeTimeout)
