"""Toxicity scores: a learnt lexicon, met with spelling errors, and windows that tell quotation from abuse.

The lexicon holds words and stems (prefixes) that occur in far more toxic than clean labelled texts, and in a share of
MIN_TOXIC of the toxic ones and MIN_TEXTS of them at least; so it has no more entries than 1 / MIN_TOXIC times what a
toxic text holds on average, whatever the input. It is a trie; a
Levenshtein automaton runs along it. The product is made deterministic while it is used: a state is a set of trie nodes
with the errors spent so far, a word costs one dictionary look-up per letter, and words that are no near match die after
a few letters. Words of LONG letters or more may have one error (a wrong, extra or missing letter); stems none. Words
that clean texts hold are no misspellings. Digits and signs that look like letters are read as these.

Each match is abuse or quotation, by quotation marks and reporting words within WINDOW words on either side. A logistic
regression on counts and density of both kinds of match gives the score, learnt from at most FIT_ROWS labelled keys,
those with the least hashes. Labels never enter a score otherwise; held-out rows are not learnt from.

Null or empty text: no matches, so the score of a text without any. Null key: its text for the split is empty. Repeated
rows: one output row each; repeated labels of a key: the largest. No labels of one kind: every score is the share of
toxic labels (none: 0). Empty table: no rows. Very long text: one row of one task, read once. Other columns pass through;
those called as a result's column are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_mod, materialize, with_fields
from tidemark.shipping import ship

FIT_ROWS, MIN_TEXTS, MIN_TOXIC = 50_000, 4, 0.02
LONG, WINDOW, STEMS = 5, 4, range(4, 8)
#: Words that a task remembers, and terms that it counts, before it starts anew.
MEMORY = 150_000
#: Log odds that an entry must reach: how much likelier a toxic text holds it than a clean one.
WORD_ODDS, STEM_ODDS = 2.5, 3.0
TOKEN = re.compile(r"\w(?:[\w@$*!]*\w)?|[\"“”«»„]")
QUOTES = frozenset('"“”«»„')
# Words that report what somebody else said, in the languages of the texts; signs read as letters.
REPORTING = frozenset("said says quoted quote called wrote term word sagte nannte zitat wort dit disait citation mot dijo cita palabra".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EXACT, NEAR, STEM = 1, 2, 3


@dataclass
class Lexicon:
    """Words and stems in a trie: nodes are numbers, next_[node] maps a letter to a node."""

    words: list[str]
    stems: list[str]
    clean: frozenset = frozenset()
    next_: list[dict] = field(default_factory=lambda: [{}])
    ends: set = field(default_factory=set)
    stem_ends: set = field(default_factory=set)

    def __post_init__(self) -> None:
        # may_err[node]: a word of LONG letters or more goes through the node
        self.may_err = {0}
        for entry, ends in [*((w, self.ends) for w in self.words), *((s, self.stem_ends) for s in self.stems)]:
            node = 0
            for letter in entry:
                if letter not in self.next_[node]:
                    self.next_[node][letter] = len(self.next_)
                    self.next_.append({})
                node = self.next_[node][letter]
                if ends is self.ends and len(entry) >= LONG:
                    self.may_err.add(node)
            ends.add(node)
        self.long_ends = set()
        for w in self.words:
            node = 0
            for letter in w:
                node = self.next_[node][letter]
            if len(w) >= LONG:
                self.long_ends.add(node)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict] = []
        self.kinds: list[int] = []
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, items: set) -> frozenset:
        """With the nodes that are reached if the word lacks a letter of the entry."""
        more = {(child, 1) for node, errors in items if errors == 0 and node >= 0 and node in self.may_err for child in self.next_[node].values() if child in self.may_err}
        return frozenset(items | {x for x in more if (x[0], 0) not in items})

    def _number(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
            if (-1, 0) in items:
                kind = STEM
            elif any(e == 0 and n in self.ends for n, e in items):
                kind = EXACT
            else:
                kind = NEAR if any(e == 1 and n in self.long_ends for n, e in items) else 0
            self.kinds.append(kind)
        return self.states[items]

    def _move(self, state: int, letter: str) -> int:
        items = set()
        for node, errors in self.sets[state]:
            if node == -1:
                items.add((-1, 0))  # behind a stem anything may follow
                continue
            child = self.next_[node].get(letter)
            if child is not None and (errors == 0 or child in self.may_err):
                items.add((child, errors))
                if errors == 0 and child in self.stem_ends:
                    items.add((-1, 0))
            if errors == 0 and node in self.may_err:
                items.add((node, 1))
                items.update((c, 1) for c in self.next_[node].values() if c in self.may_err)
        items = {(n, e) for n, e in items if e == 0 or (n, 0) not in items}
        to = self._number(self._closed(items))
        self.moves[state][letter] = to
        return to

    def match(self, word: str) -> int:
        """EXACT, NEAR, STEM or 0 for a lower-case word."""
        state = self.start
        for letter in word:
            to = self.moves[state].get(letter)
            state = self._move(state, letter) if to is None else to
            if not self.sets[state]:
                return 0
        kind = self.kinds[state]
        if kind == NEAR and (len(word) < LONG - 1 or word in self.clean):
            return 0
        return kind


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def plain(word: str) -> str:
    """A word with look-alike signs read as letters, if it has some letter."""
    return word if word.isalpha() or not any(c.isalpha() for c in word) else word.translate(LOOKALIKE)


class Matcher:
    """Matches of texts, with a memory of words that is emptied when it is full."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.known = lexicon, {}

    def kind(self, word: str) -> int:
        k = self.known.get(word)
        if k is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            k = self.known[word] = self.lexicon.match(plain(word))
        return k

    def matches(self, words: list[str]) -> list[tuple[int, int, bool]]:
        """Place, kind and whether it is quotation, for each match."""
        # Kinds are kept for the text, as the memory may be emptied meanwhile.
        kinds = {w: k for w in set(words) if (k := self.kind(w))}
        out = []
        for i in [i for i, w in enumerate(words) if w in kinds] if kinds else []:
            before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            quoted = bool(QUOTES & set(before) and QUOTES & set(after)) or bool(REPORTING & set(before))
            out.append((i, kinds[words[i]], quoted))
        return out

    def features(self, words: list[str]) -> list[float]:
        n = Counter((k, q) for _, k, q in self.matches(words))
        abuse, quoted = sum(v for (_, q), v in n.items() if not q), sum(v for (_, q), v in n.items() if q)
        near = sum(v for (k, q), v in n.items() if k == NEAR and not q)
        stems = sum(v for (k, q), v in n.items() if k == STEM and not q)
        return [1.0, float(abuse > near), math.log1p(abuse - near), math.log1p(near), math.log1p(stems), math.log1p(quoted), 100.0 * abuse / (len(words) + 50)]


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps; the first column is the constant and is not held back."""
    w = np.zeros(x.shape[1])
    hold = ridge * np.eye(len(w))
    hold[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + hold, x.T @ (y - p) - hold @ w)
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    share: float | None = None  # the score of every text, if there was nothing to learn from

    def score(self, features: list[float]) -> float:
        if self.share is not None:
            return self.share
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(features, self.weights))))))


def _terms(words: list[str]) -> set[str]:
    """The distinct words of a text, and their stems behind a mark."""
    found = {plain(w) for w in words}
    return {w for w in found if len(w) > 2 and w.isalpha()} | {"^" + w[:n] for w in found for n in STEMS if len(w) > n and w.isalpha()}


def choose(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """The lexicon from (term, toxic texts, clean texts). A stem is taken if it covers more toxic texts than any one word of it."""
    odds = lambda t, c: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    words = {t: n for t, n, c in rows if t[0] != "^" and odds(n, c) >= WORD_ODDS}
    best: dict[str, int] = {}
    for w, n in words.items():
        for k in STEMS:
            best[w[:k]] = max(best.get(w[:k], 0), n)
    stems = {t[1:]: n for t, n, c in rows if t[0] == "^" and odds(n, c) >= STEM_ODDS and n > 1.2 * best.get(t[1:], 0)}
    # A longer stem of a chosen one says nothing more.
    kept = [s for s in sorted(stems, key=lambda s: (len(s), s)) if not any(s[:k] in stems for k in STEMS if k < len(s))]
    # Words of a stem stay, as a stem takes no error and they do.
    return Lexicon(sorted(words), sorted(kept))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", held: int = 0) -> Model:
    """Learns from rows of docs that have a label and whose remainder is not `held`."""
    spark = docs.sparkSession
    ship(spark)
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc32_mod(F.col(key), 5) != held))
    known = usable.groupBy(F.col(key).alias("__k")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    known = materialize(known.orderBy(F.xxhash64("__k"), "__k").limit(FIT_ROWS), "labels")
    # FIT_ROWS rows at most, so the texts need not be dealt.
    rows = docs.select(key, text).join(F.broadcast(known), F.col(key) == F.col("__k")).select("__y", F.coalesce(F.col(text), F.lit("")).alias("t"))
    # A text counts once, however many copies it has.
    rows = materialize(rows.groupBy("__y", F.xxhash64("t").alias("h")).agg(F.first("t").alias("t")).drop("h"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found, "string"), pa.array([v[1] for v in found.values()], "int64"), pa.array([v[0] for v in found.values()], "int64")], names=["term", "toxic", "clean"])
            found.clear()
            return batch

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for term in (*_terms(words_of(t)), "^"):
                    found.setdefault(term, [0, 0])[int(y > 0)] += 1
                if len(found) > MEMORY:
                    yield taken()
        yield taken()

    counts = rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialize(counts, "terms")
    total = counts.filter("term = '^'").first()
    toxic, clean = (total.toxic, total.clean) if total else (0, 0)
    if not toxic or not clean:
        return Model(Lexicon([], []), np.zeros(7), toxic / (toxic + clean) if toxic + clean else 0.0)
    likely = counts.filter((F.col("toxic") >= max(MIN_TEXTS, MIN_TOXIC * toxic)) & (F.col("toxic") * (clean + 1.0) > F.col("clean") * (toxic + 1.0) * math.exp(WORD_ODDS)) & (F.col("term") != "^"))
    lexicon = choose([tuple(r) for r in likely.collect()], toxic, clean)
    first = spark.sparkContext.broadcast(lexicon)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for t in b.column(0).to_pylist() if first.value.match(t) == NEAR], "string")], names=["term"])

    # Words of clean texts that a misspelling would hit: a few for each letter of the lexicon, among those of FIT_ROWS texts.
    near = counts.filter("clean > 0 and substr(term, 1, 1) <> '^'").select("term").mapInArrow(spelt, "term string").collect()
    lexicon = Lexicon(lexicon.words, lexicon.stems, frozenset(r.term for r in near))
    full = spark.sparkContext.broadcast(lexicon)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(full.value)
        for b in batches:
            x = [m.features(words_of(t)) for t in b.column(1).to_pylist()]
            lists = pa.array(x, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["y", "x"])

    sample = rows.mapInArrow(featured, "y int, x array<double>").toArrow()
    x, y = np.array(sample.column("x").to_pylist()), (sample.column("y").to_numpy() > 0).astype("f8")
    return Model(lexicon, fitted(x, y))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose text scores less than a half, unchanged."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        m = Matcher(model.lexicon)
        for b in batches:
            yield b.filter(pa.array([model.score(m.features(words_of(t))) < 0.5 for t in b.column(text).to_pylist()], "bool"))

    return docs.mapInArrow(work, docs.schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", held: int = 0) -> DataFrame:
    """docs without the text, plus held_out, score, predicted, matches (array of place in words, kind, quoted)."""
    names = [c for c in docs.columns if c not in (text, "held_out", "score", "predicted", "matches")]
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = with_fields(docs.select(*names).schema, "score double, matches array<struct<word:int,kind:int,quoted:boolean>>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        m = Matcher(model.lexicon)
        for b in batches:
            scores, found = [], []
            for t in b.column(text).to_pylist():
                words = words_of(t)
                scores.append(model.score(m.features(words)))
                found.append([{"word": i, "kind": k, "quoted": q} for i, k, q in m.matches(words)])
            matches = pa.array(found, pa.list_(pa.struct([("word", pa.int32()), ("kind", pa.int32()), ("quoted", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(scores, "float64"), matches], names=[*names, "score", "matches"])

    made = docs.select(*names, text).mapInArrow(work, kind)
    return made.withColumn("held_out", crc32_mod(F.col(key), 5) == held).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
