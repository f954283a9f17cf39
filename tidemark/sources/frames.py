"""A Spark data source for logs of frames that grow: restarts by offsets, bounded parts, and signals where something may be lost.

A log is a folder of files to which frames are appended, one a line; files may be added, and go once they are read. An
offset has the bytes read of each file, so a restart goes on where the last batch ended: no frame is lost or comes twice.
A batch reads whole frames only, in parts of at most part_bytes, and of each file at most batch_bytes beyond what was read.
A frame of more than max_frame bytes is dropped and gives a signal, oversized_frame; where no file grew for idle_s
seconds, a signal idle_timeout comes, once for each such time. Files called *.signals hold reasons that a writer gives.

Feed is such a writer: a bounded queue that takes a frame or refuses it at once, and says in the log that it had to.
"""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.shipping import ship
from tidemark.sources.files import MAX_FRAME, REASONS, register

SCHEMA = "topic string, payload string, observed_at timestamp, signal string"
CHUNK = 1 << 16
DEFAULTS = {"topic": "", "max_frame": MAX_FRAME, "part_bytes": 16 << 20, "batch_bytes": 256 << 20, "idle_s": 0}


class Part(InputPartition):
    """Bytes lo to hi of a file, which begin and end with whole frames; or a reason alone."""

    def __init__(self, path: str, lo: int, hi: int, at_ms: int, reason: str | None = None) -> None:
        self.path, self.lo, self.hi, self.at_ms, self.reason = path, lo, hi, at_ms, reason


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


class FrameReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        given = {k: options.get(k, v) for k, v in DEFAULTS.items()}
        self.topic, self.path = given["topic"], options["path"]
        self.max_frame, self.part_bytes, self.batch_bytes, self.idle_s = (int(given[k]) for k in ("max_frame", "part_bytes", "batch_bytes", "idle_s"))
        #: The offset that the next batch begins with, as far as this reader has seen, and when a file last grew.
        self.known: dict | None = None
        self.grew = time.time()

    def initialOffset(self) -> dict:
        self.known = {"files": {}, "idle": 0, "at_ms": 0}
        return self.known

    def _sizes(self) -> dict[str, int]:
        from pyarrow import fs

        store, folder = _fs(self.path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {os.path.basename(f.path): f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}

    def _ends(self, name: str, size: int, lo: int) -> int:
        """The end of the last whole frame in the first size bytes, not before lo."""
        store, folder = _fs(self.path)
        with store.open_input_file(f"{folder}/{name}") as f:
            hi = size
            while hi > lo:
                start = max(lo, hi - CHUNK)
                at = f.read_at(hi - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                hi = start
        return lo

    def latestOffset(self) -> dict:
        before, now = self.known or {"files": {}, "idle": 0, "at_ms": 0}, time.time()
        files = {}
        for name, size in self._sizes().items():
            lo = before["files"].get(name, 0)
            # A restarted reader does not know yet what was read; its first batch takes all there is.
            most = size if self.known is None else min(size, lo + self.batch_bytes)
            files[name] = self._ends(name, most, lo)
            if files[name] == lo and most < size:  # a frame longer than a batch: whole, so that it can be dropped
                files[name] = self._ends(name, size, lo)
        if files != before["files"]:
            self.grew = now
            self.known = {"files": files, "idle": before["idle"], "at_ms": int(now * 1000)}
        elif self.idle_s and now - self.grew >= self.idle_s:
            self.grew = now
            self.known = {"files": files, "idle": int(now * 1000), "at_ms": int(now * 1000)}
        return self.known or before

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.known = end if self.known is None else self.known
        out = []
        for name, hi in sorted(end["files"].items()):
            lo = start["files"].get(name, 0)
            while lo < hi:
                to = hi if hi - lo <= self.part_bytes else self._ends(name, lo + self.part_bytes, lo)
                to = hi if to == lo else to
                out.append(Part(name, lo, to, end["at_ms"]))
                lo = to
        if end["idle"] > start["idle"]:
            out.append(Part("", 0, 0, end["at_ms"], "idle_timeout"))
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        at = datetime.fromtimestamp(part.at_ms / 1000, timezone.utc)
        if part.reason:
            yield self.topic, None, at, part.reason
            return
        store, folder = _fs(self.path)
        signals = part.path.endswith(".signals")
        with store.open_input_file(f"{folder}/{part.path}") as f:
            rest, long, lo = b"", False, part.lo
            while lo < part.hi:
                data = f.read_at(min(1 << 20, part.hi - lo), lo)
                if not data:
                    raise OSError(f"{part.path} is shorter than it was")
                lo += len(data)
                *lines, rest = (rest + data).split(b"\n")
                for i, line in enumerate(lines):
                    if len(line) > self.max_frame or long and i == 0:
                        yield self.topic, None, at, "oversized_frame"
                    elif signals:
                        if (reason := line.decode().strip()) in REASONS:
                            yield self.topic, None, at, reason
                    elif line.strip():
                        yield self.topic, line.decode("utf-8", "replace"), at, None
                long = long and not lines
                if len(rest) > self.max_frame:  # what comes up to the next end belongs to a frame that goes
                    rest, long = b"", True


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(self.options)


@register("frames")
def frame_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """topic, payload, observed_at, signal of a log of frames, as it grows. A signal has no payload."""
    ship(spark)
    spark.dataSource.register(FrameSource)
    unknown = set(options) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}; known are {sorted(DEFAULTS)}")
    return spark.readStream.format("frames").options(path=path, **options).load()


class Feed:
    """A queue in front of a log: offer() never waits. flush() appends what is queued, and a signal if frames were refused since the last one."""

    def __init__(self, folder: str, name: str = "feed", most: int = 4096) -> None:
        self.folder, self.name, self.most = folder, name, most
        self.queue: list[str] = []
        self.refused = self.lost = 0
        self.lock = threading.Lock()

    def offer(self, payload: str) -> bool:
        if "\n" in payload:
            raise ValueError("a frame is one line")
        with self.lock:
            if len(self.queue) >= self.most:
                self.refused, self.lost = self.refused + 1, self.lost + 1
                return False
            self.queue.append(payload)
            return True

    def signal(self, reason: str) -> None:
        """Say that something may have been lost on the way here, such as by a reconnect."""
        if reason not in REASONS:
            raise ValueError(f"unknown reason {reason}")
        with open(f"{self.folder}/{self.name}.signals", "a", encoding="utf-8") as f:
            f.write(f"{reason}\n")

    def flush(self) -> int:
        with self.lock:
            rows, self.queue, lost, self.lost = self.queue, [], self.lost, 0
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.folder}/{self.name}.frames", "a", encoding="utf-8") as f:
            f.write("".join(f"{r}\n" for r in rows))
        if lost:
            self.signal("high_water_mark")
        return len(rows)
