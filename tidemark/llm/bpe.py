"""Byte-level BPE: whole texts to ids and back, exactly as the tokenizers library does it.

The vocabulary file is a parameter and is read by each Python worker once. A text is encoded by tree concatenation: its
leaves, PART code points each, on their own, then at each join of two neighbours a window that grows until it agrees with
both sides, level by level. Texts of more than SPREAD code points are leaves of a tree in rows: parts are dealt to all
tasks, encoded there, and joined where the text's ids are gathered.

A window begins and ends at places where pre-tokenisation parts a text whatever stands around (a change of the kind of
character, but for spaces before words and apostrophes), and both sides must have a border of ids there; so what lies
outside is as it would be in the whole text. A stretch of LONG code points without any such place is one piece of BPE; it
is a tree of its own, in LEAF bytes. A sequence of ids is the encoding of its bytes if every two neighbours encode to
themselves, so agreement of the window's two outer pairs is enough for exactness there.

Null text: read as the empty text. Empty text: no ids. Repeated rows: one output row each. Empty table: no rows. Very long
text: its ids are gathered in one task, as their digest and their list are one value; they are encoded in many. Special
tokens of the vocabulary are recognised in a text, as the library does by default. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import renamed, with_fields
from tidemark.shipping import ship

#: Fixed value: the public pre-tokenisation pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points of a leaf, and of a text that is dealt to many tasks; a stretch without space or newline of so many is one piece, with leaves of so many bytes.
PART, SPREAD, LONG, LEAF = 2048, 100_000, 4096, 1024


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.core._core_bpe.encode_single_piece
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.long = re.compile(r"[^ \n]{%d,}|[ \n]{%d,}" % (LONG, LONG))
        self.pieces = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # Where a letter, a digit or a sign is followed by something else. An apostrophe may belong to letters behind it.
        other = r"\p{White_Space}\p{L}\p{N}"
        self.safe = regex.compile(rf"(?<=\p{{L}})(?=\P{{L}})|(?<=\p{{N}})(?=\P{{N}})|(?<=[^{other}'])(?=[{other}])|(?<=')(?=[\p{{White_Space}}\p{{N}}])")
        self.joins = 0

    def encode(self, text: str) -> np.ndarray:
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return np.concatenate([np.array([self.special[p]], "u4") if i % 2 else self._ordinary(p) for i, p in enumerate(parts)])
        return self._ordinary(text)

    def _ordinary(self, text: str) -> np.ndarray:
        if len(text) < LONG or not self.long.search(text):
            return self.halves(text)
        out, done = [], 0
        while m := self.long.search(text, done):
            a, b = self._border(text, m.start(), done, -1), self._border(text, m.end(), m.end(), 1)
            if a > done:
                out.append(self.halves(text[done:a]))
            for p in self.pieces.findall(text[a:b]):
                out.append(np.array(self.tree(p.encode()), "u4"))
            done = b
        out.append(self.halves(text[done:]))
        return np.concatenate(out)

    def halves(self, text: str) -> np.ndarray:
        """The ids of a text without special tokens: leaves, then pairs of neighbours joined until one is left."""
        cuts = [*range(0, len(text), PART), len(text)]
        return self.joined(text, cuts, [self.core.encode_to_numpy(text[x:y], disallowed_special=()) for x, y in zip(cuts, cuts[1:])])

    def joined(self, text: str, cuts: list[int], parts: list[np.ndarray]) -> np.ndarray:
        """The ids of a text from those of its parts between cuts."""
        while len(parts) > 1:
            pairs = range(0, len(parts) - 1, 2)
            parts = [self.concatenated(text, *cuts[i : i + 3], *parts[i : i + 2]) for i in pairs] + parts[len(parts) & ~1 :]
            cuts = cuts[:-1:2] + cuts[-1:]
        return parts[0] if parts else np.zeros(0, "u4")

    def concatenated(self, text: str, start: int, cut: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of text[start:end] from those of its halves: a window around the cut is encoded again, larger until both sides agree."""
        self.joins += 1
        width = 32
        while True:
            lo, hi = max(start, cut - width), min(end, cut + width)
            before = [m.start() for m in self.safe.finditer(text, max(start + 1, lo), cut) if self._free(text, m.start())]
            behind = next((m.start() for m in self.safe.finditer(text, cut + 1, hi) if self._free(text, m.start())), None)
            lo, hi = before[-1] if before else start if lo == start else None, behind if behind is not None else end if hi == end else None
            if lo is not None and hi is not None:
                i, j = self._border_of_ids(left[::-1], text[lo:cut], lo == start), self._border_of_ids(right, text[cut:hi], hi == end)
                if i is not None and j is not None:
                    window = text[lo:hi]
                    ids = self.core.encode_to_numpy(window, disallowed_special=()) if hi - lo < LONG and not self._special(window) else self.encode(window)
                    return np.concatenate([left[: len(left) - i], ids, right[j:]]).astype("u4")
            width *= 2

    def _special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _free(self, text: str, at: int) -> bool:
        """Whether no special token of the vocabulary goes across the place."""
        return all(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) < 0 for s in self.special)

    def _border_of_ids(self, ids: np.ndarray, text: str, whole: bool) -> int | None:
        """How many of the ids make up the text, or None if none ends with it."""
        if whole:
            return len(ids)
        left = len(text.encode())
        for n, i in enumerate(ids):
            if left <= 0:
                return n if left == 0 else None
            left -= len(self.bytes_of[int(i)])
        return len(ids) if left == 0 else None

    @staticmethod
    def _border(text: str, at: int, least: int, step: int) -> int:
        """The nearest place at or before (after) `at` where pieces end whatever stands around: a non-space, then a space or newline."""
        while least < at < len(text) or step > 0 and at < len(text):
            if at and text[at] in " \n" and not text[at - 1].isspace():
                return at
            at += step
        return max(at, least) if step < 0 else len(text)

    def tree(self, data: bytes) -> list[int]:
        """The ids of one piece: leaves, then pairs of neighbours joined until one is left."""
        parts = [self.piece(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        k = 4
        while True:
            window = self.piece(b"".join(map(self.bytes_of.__getitem__, left[-k:] + right[:k])))
            if (k >= len(left) or self.stable(left[-k - 1], window[0])) and (k >= len(right) or self.stable(window[-1], right[k])):
                return left[:-k] + window + right[k:]
            k *= 2

    def stable(self, a: int, b: int) -> bool:
        return self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    @cached_property
    def written(self) -> list[str]:
        """Each id as decimal text."""
        return [str(i) for i in range(max(self.bytes_of) + 1)]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(docs: DataFrame, path: str, text: str, ddl: str, finish) -> DataFrame:
    """docs with more columns, which finish(codec, texts, ids) makes as arrays. Long texts go through rows of parts."""
    ship(docs.sparkSession)
    docs, back = renamed(docs)
    t = back.here(text)
    docs = docs.withColumn(t, F.coalesce(F.col(t), F.lit("")))
    kind = with_fields(docs.schema, ddl)
    names = [f.name for f in kind]
    own = docs.columns
    long = F.length(t) > SPREAD

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = b.column(t).to_pylist()
            # Equal texts of a batch are encoded once.
            seen = {x: c.encode(x) for x in set(texts)}
            yield pa.RecordBatch.from_arrays([*b.columns, *finish(c, texts, [seen[x] for x in texts])], names=names)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = pa.array([c.encode(x).astype("<u4").tobytes() for x in b.column("part_").to_pylist()], "binary")
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "ids_"])

    def gather(table: pa.Table) -> pa.Table:
        c = codec(path)
        table = table.sort_by("at_")
        parts = table.column("part_").to_pylist()
        whole, cuts = "".join(parts), np.cumsum([0, *map(len, parts)]).tolist()
        ids = c.joined(whole, cuts, [np.frombuffer(x, "<u4") for x in table.column("ids_").to_pylist()])
        first = table.slice(0, 1).combine_chunks()
        columns = [pa.array([whole], "string") if n == t else first.column(n) for n in own]
        return pa.Table.from_arrays([*columns, *finish(c, [whole], [ids])], names=names)

    rest = [c for c in docs.columns if c != t]
    parts = docs.filter(long).withColumn("row_", F.monotonically_increasing_id())
    parts = parts.select(*rest, "row_", F.posexplode(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{SPREAD}}}"), F.lit(0))).alias("at_", "part_"))
    # Dealt by text and part, so that the parts of one text are work for many tasks.
    parts = parts.repartition("row_", "at_")
    many = parts.mapInArrow(part, with_fields(parts.schema, "ids_ binary")).groupBy("row_").applyInArrow(gather, kind)
    return back(docs.filter(~long).mapInArrow(small, kind).unionByName(many), *names[len(own) :])


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with one more column: array<int>, the ids of the text."""

    def finish(c: Codec, texts: list[str], ids: list[np.ndarray]) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype("i4"), np.concatenate([*ids, np.zeros(0, "u4")]).astype("i4"))]

    made = _encoded(docs.drop(out).withColumn("__null", F.col(text).isNull()), path, text, "new_ids_ array<int>", finish)
    return made.withColumn(text, F.when(~F.col("__null"), F.col(text))).drop("__null").withColumnRenamed("new_ids_", out)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with one more column: the text of the ids. Null ids: null."""
    ship(rows.sparkSession)
    kind = with_fields(rows.drop(out).schema, f"`{out}` string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = pa.array([None if x is None else c.decode(x) for x in b.column(ids).to_pylist()], "string")
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names if n != out), texts], names=[*(n for n in b.schema.names if n != out), out])

    return rows.drop(out).mapInArrow(work, kind)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 and decoded_sha256 of a full round trip; ids stay inside the task."""

    def finish(c: Codec, texts: list[str], ids: list[np.ndarray]) -> list[pa.Array]:
        written = c.written
        sums = [hashlib.sha256(",".join(map(written.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
        back = [hashlib.sha256(c.decode(x.tolist()).encode()).hexdigest() for x in ids]
        return [pa.array([len(x) for x in ids], "int64"), pa.array(sums, "string"), pa.array(back, "string")]

    return _encoded(docs, path, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish).drop(text)
