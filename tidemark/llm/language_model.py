"""Language-model scores by a probabilistic suffix tree over words, beside a plain unigram score.

Tokens are maximal runs without white space, A-Z lower-cased, and one end per text; DEPTH end tokens also stand before a
text, as its first context. All words unknown to the training texts are one type, as in the unigram score.

The root predicts by the unigram distribution. A context is up to DEPTH preceding tokens. A next token is counted in a
context if it occurs there MIN_COUNT times, at every size of the input, and with a share of NEXT_SHARE (which only matters
in contexts that occur millions of times). A context is retained if its next tokens diverge from what the context one
token shorter predicts: count times divergence must exceed GAIN_EACH nats for each of them and GAIN more. A retained
context predicts (n + m * p) / (c + k): n is the next token's count, c the context's, k its number of counted next tokens,
p the shorter context's prediction, and m = c + k less all n, so that it sums to one. A token is scored in the state of
the longest retained suffix.

A branch of the tree is all contexts that end in the same token, and needs no other branch. So each token goes, with its
context, to the bucket of its branch, once; there the branch is learnt and the token scored, and a sum for each text
comes back. Blocks of texts travel as compressed columns. Equal tokens of a text in equal contexts travel once.

A context token with a share of more than 1 / (2 * buckets) has its branch split by the token before it, over as many
buckets in a row as its share asks for, laid out one token after the other, so a bucket meets five split tokens or so.
What follows a split token is counted ahead, in a table, and travels to that token's buckets, compressed. The driver and
the broadcast hold the split tokens themselves, at most two for each bucket (a million tokens), and nothing of what
follows them.

Word counts are exact for all words. The HEAD most frequent words are numbered and broadcast; all others are joined for
the unigram score, and in a retained context's prediction of one of them the root's part is that of the unknown type.
Words and contexts are told apart by 64-bit hashes.

Null text: read as the empty text, which is one end token. Null key: its text for the split is empty. Repeated rows: one
output row each. Empty table: no rows; without training rows every token has the one unknown type. Very long text: a
block of its own in one task, and its tokens are dealt like all others. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import free_name, materialize, with_fields
from tidemark.llm.shingles import BYTES, Powers, mixed, words_of
from tidemark.shipping import ship

DEPTH, MIN_COUNT, NEXT_SHARE, GAIN_EACH, GAIN = 3, 2, 1e-6, 2.0, 10.0
#: Words that are broadcast; buckets at least, and tokens for one bucket; characters of a block of texts.
HEAD, BUCKETS, BUCKET_TOKENS, BLOCK = 2_500_000, 128, 1_000_000, 4_000_000
ENDS = np.uint64(0)  # stands for the end token among the hashes
TOP = np.uint64(1 << 63)  # marks the hash of a word that has no number
#: What a row between the stages holds: tokens of a bucket, the texts of a block, their words without a number, sums of a bucket, words that no context predicted, what follows a split token.
TOKENS, TEXTS, WORDS, SUMS, FALLEN, NEXTS = range(6)
DEALT = "bucket int, block long, what tinyint, n int, body binary"


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    if not words:
        return np.zeros(0, "u8")
    data = np.frombuffer(b" ".join(words), "u1")
    Powers.upto(len(data) + 1)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(BYTES[data] * Powers.up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * Powers.down[starts])


def joined(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The hash of a context and one token more."""
    return mixed(context * np.uint64(0x9E3779B97F4A7C15) + mixed(token + np.uint64(1)))


def remainder(key, n: int = 5) -> int:
    return zlib.crc32(("" if key is None else str(key)).encode()) % n


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of all tokens, DEPTH ends before each text and one behind it; each token's place among them; where scored tokens are, and their texts."""
    parts, lengths = [], []
    ends = np.full(DEPTH, ENDS)
    for t in texts:
        h = word_hashes(words_of(t))
        parts += [ends, h, ends[:1]]
        lengths.append(len(h) + 1)
    distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
    text = np.repeat(np.arange(len(texts)), lengths)
    return distinct, place, np.arange(len(text)) + DEPTH * (text + 1), text


def find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(x), -1, "i8")
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def decided(context: np.ndarray, n: np.ndarray, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of next tokens (number of the context, count n, prediction s of the shorter context) which are counted, and p; of contexts (count c) which are retained, and what they leave to the shorter one."""
    counted = (n >= MIN_COUNT) & (n >= NEXT_SHARE * c[context])
    at = context[counted]
    kinds = np.bincount(at, minlength=len(c)).astype("f8")
    open_ = c - np.bincount(at, n[counted], len(c))
    below = np.maximum(c + kinds, 1)
    rest = (open_ + kinds) / below
    p = (n + (open_ + kinds)[context] * s) / below[context]
    gain = np.bincount(at, n[counted] * np.log(p[counted] / s[counted]), len(c)) + open_ * np.log(np.maximum(rest, 1e-300))
    return counted, p, (kinds > 0) & (gain > GAIN_EACH * kinds + GAIN), rest


@dataclass
class Roots:
    """The unigram distribution with numbers for the most frequent words, and which branches are split."""

    words: np.ndarray  # sorted hashes of the numbered words
    number: np.ndarray  # of each of these
    count: np.ndarray  # by number
    below: float
    split: np.ndarray  # sorted tokens whose branches are split
    whole: np.ndarray  # how often each of these occurs
    parts: np.ndarray  # in how many buckets its branch is
    start: np.ndarray  # the first of them
    buckets: int
    tail: bool  # whether some words have no number

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = find(self.words, hashes)
        return np.where(at >= 0, self.number[at] if len(self.words) else np.uint64(0), hashes | TOP)

    @property
    def unknown(self) -> float:
        return 0.5 / self.below

    def predict(self, ids: np.ndarray) -> np.ndarray:
        known = ids < TOP
        return np.where(known, (self.count[np.where(known, ids, 0).astype("i8")] + 0.5) / self.below if len(self.count) else 0.0, self.unknown)

    def bucket(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        home = ((mixed(last) >> np.uint64(33)) % np.uint64(self.buckets)).astype("i8")
        of = find(self.split, last)
        i = np.flatnonzero(of >= 0)
        place = (joined(last[i], before[i]) >> np.uint64(33)).astype("i8") % self.parts[of[i]]
        home[i] = (self.start[of[i]] + place) % self.buckets
        return home.astype("i4")


class FirstLevel:
    """Predictions of what follows the split tokens, from the counts that a bucket was sent."""

    def __init__(self, roots: Roots, of: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
        """of: places among the split tokens. A split token that nothing was sent for has no next token that counts."""
        counted, p, self.retained, self.rest = decided(of, n.astype("f8"), roots.predict(word), roots.whole.astype("f8"))
        nexts, p = joined(roots.split[of[counted]], word[counted]), p[counted]
        order = np.argsort(nexts)
        self.split, self.nexts, self.p = roots.split, nexts[order], p[order]

    def amend(self, context: np.ndarray, word: np.ndarray, state: np.ndarray, hit: np.ndarray, value: np.ndarray, left: np.ndarray) -> None:
        """Put in what is known of contexts that are split tokens, in place."""
        which = find(self.split, context)
        i = np.flatnonzero(which >= 0)
        found = find(self.nexts, joined(context[i], word[i]))
        state[i], hit[i], left[i] = self.retained[which[i]], found >= 0, self.rest[which[i]]
        value[i] = self.p[found] if len(self.p) else 0.0


def branches(word: np.ndarray, before: list[np.ndarray], n: np.ndarray, learnt: np.ndarray, roots: Roots, first: FirstLevel) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of tokens, given the DEPTH before each (nearest first), and whether it is left to the root; learnt from those of the n that are `learnt`."""
    p, fallen, context = roots.predict(word), np.ones(len(word), bool), None
    seen = np.where(learnt, n, 0).astype("f8")
    for k in range(DEPTH):
        context = before[0] if k == 0 else joined(context, before[k])
        contexts, at = np.unique(context, return_inverse=True)
        nexts, gram = np.unique(joined(context, word), return_inverse=True)
        of, s = np.empty(len(nexts), "i8"), np.empty(len(nexts))
        of[gram], s[gram] = at, p
        counted, own, retained, rest = decided(of, np.bincount(gram, seen, len(nexts)), s, np.bincount(at, seen, len(contexts)))
        state, hit, value, left = retained[at], counted[gram], own[gram], rest[at]
        if k == 0:
            first.amend(context, word, state, hit, value, left)
        p = np.where(state, np.where(hit, value, left * p), p)
        fallen &= ~(state & hit)
    return p, fallen


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Keys and texts, in blocks of bounded size (or one text)."""
    for b in batches:
        keys, texts, size = [], [], 0
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            keys.append(k), texts.append(t)
            size += len(t or "")
            if size > BLOCK:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte by byte, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view("u1").reshape(len(c), -1).T.tobytes() for c in columns), "zstd", asbytes=True)


def _unpacked(body: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw, at, out = np.frombuffer(pa.decompress(body, n * sum(sizes), "zstd"), "u1"), 0, []
    for k, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k)[:, 0])
        at += n * size
    return out


def _once(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct combination stands first, in order, and how often it occurs."""
    key = np.zeros(len(columns[0]), "u8")
    for c in columns:
        key = joined(key, c.astype("u8"))
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(first)
    return first[order], n[order]


def _counted(docs: DataFrame, key: str, text: str, held: int) -> DataFrame:
    """key, n: the tokens of the training rows by hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _blocks(batches):
            if texts := [t for k, t in zip(keys, texts) if remainder(k) != held]:
                distinct, place, at, _ = tokens(texts)
                n = np.bincount(place[at], minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array(distinct[n > 0].view("i8")), pa.array(n[n > 0])], names=["key", "n"])

    return materialize(docs.select(key, text).mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")


def _split_nexts(docs: DataFrame, key: str, text: str, held: int, model: Broadcast) -> DataFrame:
    """Rows (as DEALT) with what follows the split tokens and how often, for each bucket that a token's branch is in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = model.value
        for keys, texts in _blocks(batches):
            if texts := [t for k, t in zip(keys, texts) if remainder(k) != held]:
                distinct, place, at, _ = tokens(texts)
                ids = r.ids(distinct)[place]
                of = find(r.split, ids[at - 1])
                of, word = of[of >= 0], ids[at[of >= 0]]
                first, n = _once(of, word)
                yield pa.RecordBatch.from_arrays([pa.array(of[first].astype("i4")), pa.array(word[first].view("i8")), pa.array(n)], names=["of", "word", "n"])

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        r, table = model.value, pa.Table.from_batches(batches)
        of, word, n = (table.column(c).to_numpy() for c in ("of", "word", "n"))
        kept = n >= NEXT_SHARE * r.whole[of]
        of, word, n = of[kept], word[kept].view("u8"), n[kept]
        order = np.lexsort((word, of))
        of, word, n = of[order], word[order], n[order].astype("u8")
        there, edges = np.unique(of, return_index=True)
        rows = [_row(int(r.start[t]), int(t), NEXTS, y - x, _packed(word[x:y], n[x:y])) for t, x, y in zip(there.tolist(), edges, [*edges[1:], len(of)])]
        return _batch([x | {"parts": int(r.parts[x["block"]])} for x in rows], f"{DEALT}, parts int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BUCKET_TOKENS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    total = docs.select(key, text).mapInArrow(count, "of int, word long, n long").groupBy("of", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    # A token's counts travel once for each of its buckets.
    sent = total.mapInArrow(pack, f"{DEALT}, parts int").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return sent.select(((F.col("bucket") + F.col("part")) % model.value.buckets).cast("int").alias("bucket"), "block", "what", "n", "body")


def _least(counts: DataFrame, most: int) -> int:
    """A power of two such that at most so many rows have an n of it or more."""
    by_power = {r.p: r.k for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, room = 63, most
    while least > 0 and by_power.get(least - 1, 0) <= room:
        least -= 1
        room -= by_power.get(least, 0)
    return 1 << least


def _roots(counts: DataFrame, total: int, kinds: int, limit: int) -> Roots:
    """The distribution with the words that occur `limit` times numbered, most frequent first, and the split branches laid out."""
    found = counts.filter(F.col("n") >= limit).toArrow()
    words, n = found.column("key").to_numpy().view("u8"), found.column("n").to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    number = np.empty(len(words), "u8")
    rank = np.argsort(-n, kind="stable")
    number[rank] = np.arange(len(words), dtype="u8")
    buckets = max(BUCKETS, total // BUCKET_TOKENS)
    # 2 * buckets tokens at most.
    large = counts.filter(F.col("n") > total / (2 * buckets)).toArrow()
    split, whole = large.column("key").to_numpy().view("u8"), large.column("n").to_numpy()
    parts = np.clip(np.ceil(2 * buckets * whole / max(total, 1)).astype("i8"), 1, buckets)
    roots = Roots(words, number, n[rank], total + 0.5 * (kinds + 1), split, whole, parts, parts, buckets, limit > 1)
    order = np.argsort(roots.ids(split))
    roots.split, roots.whole, roots.parts = roots.ids(split)[order], whole[order], parts[order]
    roots.start = (np.cumsum(roots.parts) - roots.parts) % buckets
    return roots


def _row(bucket: int, block: int, what: int, n: int, body: bytes) -> dict:
    return {"bucket": bucket, "block": block, "what": what, "n": n, "body": body}


def _batch(rows: list[dict], schema: str = DEALT) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "tinyint": pa.int8(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[k]) for c, k in names], names=[c for c, _ in names])


def _written(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held: int = 1) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows whose remainder is not `held`.

    A key that is called like another column of the result is called <name>_key there.
    """
    spark = docs.sparkSession
    ship(spark)
    name = free_name(key, ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    docs = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text_of"))
    key, text = "__key", "__text_of"
    counts = _counted(docs, key, text, held)
    facts = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = facts.n or 0, facts.v or 0
    limit = _least(counts, HEAD)
    roots = _roots(counts, total, kinds, limit)
    model = spark.sparkContext.broadcast(roots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = model.value
        block = TaskContext.get().partitionId() << 32
        for keys, texts in _blocks(batches):
            m = len(keys)
            distinct, place, at, doc = tokens(texts)
            train = np.array([remainder(k) != held for k in keys])
            ids = r.ids(distinct)
            own, known = np.log10(r.predict(ids)), ids < TOP
            late = r.tail & ~known
            ids, word = ids[place], place[at]
            sums = lambda x: np.bincount(doc, x[word], m)
            texts_ = pa.RecordBatch.from_arrays([
                pa.array(keys, key_type), pa.array(~train), pa.array(np.bincount(doc, minlength=m)), pa.array(sums(known).astype("i8")), pa.array(sums(np.where(late, 0.0, own))),
            ], names=["key", "held_out", "n_tokens", "n_known", "base"])
            home = (block * 2654435761 >> 7) % r.buckets
            rows = [_row(home, block, TEXTS, m, _written(texts_))]
            if len(i := np.flatnonzero(late[word])):
                first, n = _once(doc[i], ids[at[i]])
                rows.append(_row(home, block, WORDS, len(first), _packed(doc[i][first].astype("u4"), ids[at[i]][first], n.astype("u4"))))
            columns = [ids[at], *(ids[at - k] for k in range(1, DEPTH + 1))]
            first, n = _once(doc, *columns)
            columns = [c[first] for c in columns]
            columns += [(doc[first] << 1 | train[doc[first]]).astype("u4"), n.astype("u4")]
            bucket = r.bucket(columns[1], columns[2])
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(r.buckets + 1))
            for b, x, y in zip(range(r.buckets), edges, edges[1:]):
                if y > x:
                    rows.append(_row(b, block, TOKENS, y - x, _packed(*(c[order[x:y]] for c in columns))))
            yield _batch(rows)
            block += 1

    def learn(table: pa.Table) -> pa.Table:
        rows, r = table.to_pylist(), model.value
        passed = [x for x in rows if x["what"] not in (TOKENS, NEXTS)]
        nexts = [x for x in rows if x["what"] == NEXTS]
        rows = sorted((x for x in rows if x["what"] == TOKENS), key=lambda x: x["block"])
        if rows:
            parts = [_unpacked(x.pop("body"), x["n"], *["u8"] * (DEPTH + 1), "u4", "u4") for x in rows]
            word, *before, doc, n = (np.concatenate(c) for c in zip(*parts))
            del parts
            sent = [(np.full(x["n"], x["block"]), *_unpacked(x["body"], x["n"], "u8", "u8")) for x in nexts]
            of, follows, often = (np.concatenate(c) for c in zip((np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "u8")), *sent))
            p, fallen = branches(word, before, n, (doc & 1).astype(bool), r, FirstLevel(r, of, follows, often))
            fallen &= (word >= TOP) & r.tail
            value = n * np.log10(np.where(fallen, p / r.unknown, p))
            at = 0
            for x in rows:
                part = slice(at, at := at + x["n"])
                d = (doc[part] >> 1).astype("i8")
                there = np.flatnonzero(np.bincount(d))
                passed.append(_row(x["bucket"], x["block"], SUMS, len(there), _packed(there.astype("u4"), np.bincount(d, value[part])[there])))
                if len(i := np.flatnonzero(fallen[part])):
                    passed.append(_row(x["bucket"], x["block"], FALLEN, len(i), _packed(d[i].astype("u4"), word[part][i], n[part][i])))
        return pa.Table.from_batches([_batch(passed)])

    def gather(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: (x["what"], x["bucket"]))
        facts = pa.ipc.open_stream(next(x["body"] for x in rows if x["what"] == TEXTS)).read_all().combine_chunks()
        m, block = facts.num_rows, rows[0]["block"]
        sums, left = np.zeros(m), {}
        for x in rows:
            if x["what"] == SUMS:
                d, value = _unpacked(x["body"], x["n"], "u4", "f8")
                sums[d] += value
            elif x["what"] in (WORDS, FALLEN):
                for d, w, n in zip(*(c.tolist() for c in _unpacked(x["body"], x["n"], "u4", "u8", "u4"))):
                    left.setdefault(d, {}).setdefault(w, [0, 0])[x["what"] == FALLEN] += n
        tails = [[{"word": w, "base": a, "path": b} for w, (a, b) in left.get(d, {}).items()] for d in range(m)]
        # A word without a number is told by all bits of its hash but the highest.
        kind = pa.list_(pa.struct([("word", pa.int64()), ("base", pa.int64()), ("path", pa.int64())]))
        tails = pa.array([[{**t, "word": t["word"] & (int(TOP) - 1)} for t in x] for x in tails], kind)
        arrays = [*(facts.column(c).combine_chunks() for c in ("key", "held_out", "n_tokens", "n_known", "base")), pa.array(sums), pa.array(np.full(m, block)), pa.array(np.arange(m)), tails]
        return pa.Table.from_arrays(arrays, names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[key].dataType)
    kind = with_fields(StructType([docs.schema[key]]), "held_out boolean, n_tokens long, n_known long, base_score double, score double, __block long, __text long, __tail array<struct<word:bigint,base:bigint,path:bigint>>")
    names = [f.name for f in kind]
    dealt = docs.mapInArrow(deal, DEALT)
    if len(roots.split):
        dealt = dealt.unionByName(_split_nexts(docs, key, text, held, model))
    done = dealt.groupBy("bucket").applyInArrow(learn, DEALT).groupBy("block").applyInArrow(gather, kind)
    if limit > 1:
        done = materialize(done, "scored")
        tail = done.select("__block", "__text", F.inline("__tail"))
        rare = counts.filter(F.col("n") < limit).select(F.col("key").bitwiseAND(F.lit(int(TOP) - 1)).alias("word"), F.log10((F.col("n") + 0.5) / F.lit(roots.below)).alias("own"))
        tail = tail.join(rare, "word", "left").withColumn("value", F.coalesce("own", F.lit(math.log10(roots.unknown))))
        tail = tail.groupBy("__block", "__text").agg(F.sum(F.col("base") * F.col("value")).alias("__base"), F.sum(F.col("path") * F.col("value")).alias("__path"), F.sum(F.when(F.col("own").isNotNull(), F.col("base"))).alias("__known"))
        done = done.drop("__tail").join(tail, ["__block", "__text"], "left").withColumns({
            "n_known": F.col("n_known") + F.coalesce("__known", F.lit(0)),
            "base_score": F.col("base_score") + F.coalesce("__base", F.lit(0.0)),
            "score": F.col("score") + F.coalesce("__path", F.lit(0.0)),
        })
    return done.select(F.col(key).alias(name), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
