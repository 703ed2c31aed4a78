"""Toxicity from a fuzzy lexicon and the context of its matches.

The lexicon is learned from labelled training documents: all words, and stems that
several words share, that the labels prove to go with toxic documents. It becomes a trie. Words are
run through the trie together with Levenshtein automata: a state is the set of (trie
node, edits so far) that the letters read can have led to, so that one step per letter
follows all terms and all misspellings at once; states are made when first needed and
kept. A window around each match tells quotation (quote marks, words of reporting) from
abuse, and a logistic curve over the counts gives the score."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import Texts, Words, batch, chunks, symbols, written
from vaultframe.llm.quality_crf import held_out, sampled

#: Labelled documents that a fit uses at most, of either label half, and bytes of these:
#: where texts are long, fewer of them are used, each one whole.
SAMPLE, SAMPLE_BYTES = 20_000, 128 << 20
THRESHOLD = 0.5
#: Toxic documents that a term needs, how many times likelier it must be there, and with
#: what probability any term at all may be taken by chance.
SUPPORT, LIFT, CHANCE = 6, 12.0, 0.01
STEM = (3, 10)
WINDOW = 8
#: Words that introduce what others said, in the languages of the corpus.
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes reported reports according term word words phrase dit disait écrit selon mot terme sagte sagt schrieb laut wort begriff dijo dice escribió según palabra término".split())
QUOTES = "\"“”„«»‹›"
#: What a match inside a quotation counts, against one that is not.
QUOTED = 0.25

_WORDS = np.array([c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)], np.uint8)
_LETTERS = np.arange(256) != 0x20
_SYMBOLS = symbols(np.arange(256, dtype=np.uint8), 17)


def split(t: Texts) -> tuple[Words, bytes]:
    """Words of letters, with hashes, and the bytes that they lie in: A-Z lower-cased; the signs of Latin-1 and general
    punctuation, quote marks among them, are no letters."""
    data = _WORDS[t.data]
    n = len(data)
    if n > 2:
        i = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] & 0xFE) == 0x80))
        data[i] = data[i + 1] = data[i + 2] = 0x20
    if n > 1:
        i = np.flatnonzero(data[:-1] == 0xC2)
        data[i] = data[i + 1] = 0x20
    return Words(Texts(data, t.offs, t.lo, t.hi), _LETTERS, _SYMBOLS), data.tobytes()


class Lexicon:
    """Terms as (text, is a stem); allowed edits grow with a term's length."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.words: list[int] = [-1]  # the term that ends at a node, as a word and as a stem
        self.begins: list[int] = [-1]
        self.room = [0]  # most edits that any term below a node allows
        for i, (text, stem) in enumerate(terms):
            at, edits = 0, self.edits(text, stem)
            self.room[0] = max(self.room[0], edits)
            for c in text:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.words.append(-1)
                    self.begins.append(-1)
                    self.room.append(0)
                at = self.next[at][c]
                self.room[at] = max(self.room[at], edits)
            (self.begins if stem else self.words)[at] = i
        self.reset()

    @staticmethod
    def edits(text: str, stem: bool) -> int:
        return 0 if stem or len(text) < 5 else 1 if len(text) < 9 else 2

    def reset(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[int] = []
        self.state(self.closed({(0, 0)}))

    def closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With letters of terms that the word leaves out."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if best.get(node, 9) <= e:
                continue
            best[node] = e
            if e < self.room[node]:
                todo += [(n, e + 1) for n in self.next[node].values()]
        return frozenset((n, e) for n, e in best.items() if e <= self.room[n])

    def state(self, pairs: frozenset) -> int:
        got = self.number.get(pairs)
        if got is None:
            got = self.number[pairs] = len(self.states)
            self.states.append(pairs)
            self.moves.append({})
            ends = [(e, w) for n, e in pairs if (w := self.words[n]) >= 0 and e <= self.edits(*self.terms[w])]
            self.accepts.append(min(ends) if ends else None)
            stems = [self.begins[n] for n, e in pairs if self.begins[n] >= 0 and e == 0]
            self.stems.append(stems[0] if stems else -1)
        return got

    def step(self, at: int, c: str) -> int:
        pairs = set()
        for node, e in self.states[at]:
            if c in self.next[node]:
                pairs.add((self.next[node][c], e))
            if e < self.room[node]:
                pairs.add((node, e + 1))  # a letter too many
                pairs |= {(n, e + 1) for n in self.next[node].values()}  # another letter
        to = self.moves[at][c] = self.state(self.closed(pairs))
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits): the word itself, else a stem that it begins with and goes on
        after, else the nearest term."""
        if len(self.states) > 200_000:
            self.reset()
        at, moves, stem = 0, self.moves, -1
        for i, c in enumerate(word):
            to = moves[at].get(c)
            at = self.step(at, c) if to is None else to
            if self.stems[at] >= 0 and i + 1 < len(word):
                stem = self.stems[at]
            if not self.states[at]:
                break
        got = self.accepts[at]
        if stem >= 0 and not (got and got[0] == 0):
            return stem, 0
        return (got[1], got[0]) if got else None


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word, and each stem with how many words, by label."""
    schema = pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("bad", pa.int64()), ("good", pa.int64())])
    counts: dict[tuple[str, bool], list[int]] = {}
    for b in batches:
        for t in chunks(b.column("text")):
            toxic = b.column("toxic").slice(t.lo, len(t)).to_pylist()
            w, data = split(t)
            for i in range(len(t)):
                words = {x.decode() for x in set(data[t.offs[i] : t.offs[i + 1]].split())}
                keys = {(w, False) for w in words} | {(w[:k], True) for w in words for k in range(STEM[0], min(STEM[1], len(w)))}
                for key in keys:
                    counts.setdefault(key, [0, 0])[0 if toxic[i] else 1] += 1
        if len(counts) > 300_000:
            yield batch(schema, [k[0] for k in counts], [k[1] for k in counts], [v[0] for v in counts.values()], [v[1] for v in counts.values()])
            counts = {}
    if counts:
        yield batch(schema, [k[0] for k in counts], [k[1] for k in counts], [v[0] for v in counts.values()], [v[1] for v in counts.values()])


def _learn(rows: list[tuple[str, bool, int, int]]) -> list[tuple[str, bool]]:
    """Lexicon from terms that the labels prove toxic: stems that are found far more often
    than any one word that begins with them, none within another, and all words."""
    words = {r[0]: r[2] for r in rows if not r[1]}
    most: Counter = Counter()
    for w, n in words.items():
        for k in range(STEM[0], min(STEM[1], len(w))):
            most[w[:k]] = max(most[w[:k]], n)
    taken: set[str] = set()  # stems and what they begin with
    stems: list[str] = []
    for s, n in sorted(((r[0], r[2]) for r in rows if r[1]), key=lambda x: (-x[1], -len(x[0]), x[0])):
        if n >= 2 * max(SUPPORT, most[s]) and s not in taken and not any(s[:k] in stems for k in range(STEM[0], len(s))):
            stems.append(s)
            taken |= {s[:k] for k in range(1, len(s) + 1)}
    return [(s, True) for s in stems] + [(w, False) for w in sorted(words, key=lambda w: (-words[w], w))]


class Scorer:
    """Lexicon and curve; counts of a text's matches."""

    def __init__(self, terms: list[tuple[str, bool]], curve: np.ndarray | None = None):
        self.terms, self.curve = terms, curve
        self._lexicon: Lexicon | None = None
        self._seen: set[int] = set()  # by hash
        self._hits: dict[int, tuple[int, int]] = {}

    def __getstate__(self):
        return {"terms": self.terms, "curve": self.curve, "_lexicon": None, "_seen": set(), "_hits": {}}

    def found(self, w: Words, data: bytes) -> np.ndarray:
        """Places among the words of those that match a term."""
        if self._lexicon is None:
            self._lexicon = Lexicon(self.terms)
        if len(self._seen) > 2_000_000:
            self._seen.clear()
            self._hits.clear()
        h, index = np.unique(w.hash, return_index=True)
        hits = []
        for x, i in zip(h.tolist(), index.tolist(), strict=True):
            if x not in self._seen:
                self._seen.add(x)
                got = self._lexicon.match(data[w.starts[i] : w.ends[i]].decode())
                if got:
                    self._hits[x] = got
            if x in self._hits:
                hits.append(x)
        return np.flatnonzero(np.isin(w.hash, np.array(hits, np.uint64)))

    def counted(self, t: Texts) -> np.ndarray:
        """Of each text the exact, misspelled and stem matches that aren't quoted (a quoted
        one counts QUOTED), quoted ones, and words."""
        w, data = split(t)
        out = np.zeros((len(t), 5))
        out[:, 4] = np.diff(w.first)
        if not self.terms or not len(w.starts):
            return out
        raw = t.data
        for i in self.found(w, data).tolist():
            doc = int(w.doc[i])
            a, z = int(w.first[doc]), int(w.first[doc + 1]) - 1
            lo, hi = max(a, i - WINDOW), min(z, i + WINDOW)
            before = raw[w.starts[lo] : w.starts[i]].tobytes().decode().rsplit("\n", 1)[-1]
            after = raw[w.ends[i] : w.ends[hi]].tobytes().decode().split("\n", 1)[0]
            if lo == a:  # marks before the first word and after the last
                before = raw[t.offs[doc] : w.starts[lo]].tobytes().decode().rsplit("\n", 1)[-1][-WINDOW:] + before
            if hi == z:
                after += raw[w.ends[hi] : t.offs[doc + 1]].tobytes().decode().split("\n", 1)[0][:WINDOW]
            marks = sum(c in QUOTES for c in before)
            said = {data[w.starts[k] : w.ends[k]].decode() for k in range(lo, i)}
            quoted = (marks % 2 == 1 and any(c in QUOTES for c in after)) or not REPORTING.isdisjoint(said)
            term, edits = self._hits[int(w.hash[i])]
            out[doc, 2 if self.terms[term][1] else 1 if edits else 0] += QUOTED if quoted else 1.0
            out[doc, 3] += quoted
        return out

    def counts(self, raw: bytes) -> tuple[float, ...]:
        """counted() of one text."""
        return tuple(self.counted(Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0, 1))[0].tolist())

    @staticmethod
    def design(counts: np.ndarray) -> np.ndarray:
        """Columns of the curve from counts()."""
        return np.stack([np.ones(len(counts)), np.minimum(counts[:, 0], 2), np.minimum(counts[:, 1], 2), np.minimum(counts[:, 2], 2), np.log1p(counts[:, :3].sum(1)), 100 * counts[:, :3].sum(1) / (counts[:, 4] + 50)], axis=1)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(counts), 0.0)
        return 1 / (1 + np.exp(-np.clip(self.design(counts) @ self.curve, -500, 500)))


def _count(scorer: Scorer):
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.int32()), ("c", pa.list_(pa.float64()))])
        for b in batches:
            for t in chunks(b.column("text")):
                yield batch(schema, b.column("toxic").slice(t.lo, len(t)), scorer.counted(t).tolist())

    return step


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """From labels (doc_id, toxic) outside the held-out fold; null labels are ignored, of
    several for a document the largest counts. Without labels of both kinds every text
    scores 0."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("toxic"))
    texts = sampled(docs, known, "toxic", sample, SAMPLE_BYTES)
    n = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Scorer([])
    counts = texts.select("text", "toxic").mapInArrow(_terms, "term string, stem boolean, bad long, good long").groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = written(counts, "terms")
    # The likelihood ratio that a term goes with toxic documents, beyond what the most
    # extreme of so many terms reaches by chance.
    total, bad, all_ = n[0] + n[1], F.col("bad"), F.col("bad") + F.col("good")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    ratio = 2 * sum((part(x, e / total) for x, e in ((bad, all_ * n[1]), (F.col("good"), all_ * n[0]), (n[1] - bad, (total - all_) * n[1]), (n[0] - F.col("good"), (total - all_) * n[0]))), F.lit(0.0))
    rate = (bad / n[1]) / ((F.col("good") + 0.5) / n[0])
    least = 2 * math.log(max(1, counts.count()) / CHANCE)
    rows = counts.filter((bad >= SUPPORT) & (rate >= LIFT) & (F.length("term") >= 3) & (ratio >= least)).collect()
    scorer = Scorer(_learn(sorted(tuple(r) for r in rows)))
    found = sorted((r[0], *r[1]) for r in texts.select("text", "toxic").mapInArrow(_count(scorer), "toxic int, c array<double>").collect())
    x, y = Scorer.design(np.array([r[1:] for r in found])), np.array([r[0] for r in found], float)
    a = np.zeros(x.shape[1])
    ridge = np.diag([0.01, *[0.5] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -500, 500)))
        a = a + np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ a), -3, 3)
    scorer.curve = a
    return scorer


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_exact", pa.float64()), ("n_fuzzy", pa.float64()), ("n_stem", pa.float64()), ("n_quoted", pa.float64())])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, toxic, ...) -> doc_id, held_out, score
    (0 to 1, higher: toxic), predicted, and the counts of matches.

    A row for each row, repeated ones too, scored on its whole text however long. Null
    and empty texts have no words and score as such; an empty table gives an empty
    result. Of terms equally near a word the first stands. Other columns, of any name,
    are ignored."""
    scorer = fitted(docs, labels)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(b.column("text")):
                c = scorer.counted(t)
                s = scorer.score(c)
                yield batch(SCORED, b.column("doc_id").slice(t.lo, len(t)), b.column("held_out").slice(t.lo, len(t)), s, (s >= threshold).astype(np.int32), c[:, 0], c[:, 1], c[:, 2], c[:, 3])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(step, "doc_id long, held_out boolean, score double, predicted int, n_exact double, n_fuzzy double, n_stem double, n_quoted double")
