"""Document quality from a linear-chain conditional random field over lines.

Each line with a word is a node, good or bad. Its features are buckets of a few ratios
(capitals, symbols, repeated words, ...) of the line itself and of its neighbours; the
chain adds weights for the label pairs of consecutive lines. Forward-backward gives each
line's probability of being bad, and the lines' lengths weigh these into the share of
the document that is bad, which a logistic curve fitted on the training documents turns
into a score. Training labels are those of documents: after a first fit, lines of bad
documents that look good are taken as good, and the field is fitted again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import WHITE, Words, batch, chunks, hashes, symbols

#: Labelled documents that a fit uses at most, the first by hash of their id, and bytes
#: of these: where texts are long, fewer of them are used, each one whole.
SAMPLE, SAMPLE_BYTES = 4000, 16 << 20
THRESHOLD = 0.3
FOLDS = 5

#: Bucket limits of each ratio of a line.
LIMITS = (
    (0.02, 0.1, 0.3, 0.6, 0.9),  # capitals among letters
    (0.003, 0.01, 0.03, 0.08, 0.15),  # symbols among characters
    (0.01, 0.03, 0.08),  # exclamation marks
    (0.02, 0.1, 0.3),  # digits
    (0.1, 0.3, 0.5, 0.7, 0.85, 0.97),  # distinct words among words
    (3.0, 4.5, 6.0, 8.0, 12.0),  # mean length of a word
    (1.5, 3.5, 6.5, 12.5, 25.5, 50.5, 100.5),  # words
    (0.02, 0.05, 0.12),  # bars
    (0.02, 0.06, 0.12, 0.2),  # beyond ASCII
    (0.005, 0.02, 0.05),  # stops
    (0.5,),  # stood in the text before
    (0.02, 0.2, 0.5, 0.8),  # words equal to the one before
)
_SIZES = np.array([len(x) + 1 for x in LIMITS])
_OFFSET = np.concatenate([[0], np.cumsum(_SIZES)])
#: Buckets of a line; its neighbours' follow, each with one more for "no neighbour".
ONE = int(_OFFSET[-1])
WIDTH = 3 * ONE + 2 + 1

_KIND = np.full(256, 8, np.int64)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A] = 0, 1, 2
_KIND[[*b"#*$%&<>~^="]] = 3
_KIND[0x21], _KIND[0x7C] = 4, 5
_KIND[[*b".,;:"]] = 6
_KIND[0xC0:], _KIND[0x80:0xC0] = 7, 9
_KIND[WHITE] = 10


def lines(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with a word: bucket indices (a row of 3 per ratio), first line of
    each text, and characters."""
    n, data = len(t), t.data
    cut = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([t.offs[:-1], cut + 1]))
    starts = starts[starts < len(data)]
    w = Words(t, ~WHITE, symbols())
    first = np.searchsorted(w.starts, np.append(starts, len(data)))
    some = np.diff(first) > 0
    ends = np.append(starts[1:], len(data))[some]
    words, first_word = np.diff(first)[some], first[:-1][some]
    starts = starts[some]
    m = len(starts)
    if not m:
        return np.zeros((0, 3 * len(LIMITS)), np.int64), np.zeros(n + 1, np.int64), np.zeros(0)
    line = np.repeat(np.arange(m), ends - starts)
    where = np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts) + np.arange(len(line))
    k = np.bincount(line * 11 + _KIND[data[where]], minlength=m * 11).reshape(m, 11).astype(float)
    chars = np.maximum(1, k[:, :9].sum(1) + k[:, 10])
    letters = np.maximum(1, k[:, 0] + k[:, 1] + k[:, 7])
    inked = np.maximum(1, k[:, :9].sum(1))
    # Words of a line: distinct ones, and those equal to the one before.
    of = np.repeat(np.arange(m), words)
    wh = w.hash[np.repeat(first_word - np.concatenate([[0], np.cumsum(words)[:-1]]), words) + np.arange(len(of))]
    order = np.lexsort((wh, of))
    new = np.ones(len(of), bool)
    new[1:] = (wh[order][1:] != wh[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=m)
    equal = np.zeros(len(of), bool)
    equal[1:] = (wh[1:] == wh[:-1]) & (of[1:] == of[:-1])
    runs = np.bincount(of[equal], minlength=m)
    doc = np.searchsorted(t.offs, starts, "right") - 1
    stop = ends - (data[ends - 1] == 10)
    h = hashes(data, starts, stop, symbols(np.arange(256, dtype=np.uint8), 7))
    order = np.lexsort((np.arange(m), h, doc))
    before = np.zeros(m, bool)
    before[order[1:]] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    ratios = (k[:, 1] / letters, k[:, 3] / chars, k[:, 4] / chars, k[:, 2] / chars, distinct / words, inked / words, words, k[:, 5] / chars, k[:, 7] / chars, k[:, 6] / chars, before, runs / words)
    own = np.stack([_OFFSET[i] + np.searchsorted(x, r, "right") for i, (x, r) in enumerate(zip(LIMITS, ratios, strict=True))], axis=1)
    first_line = np.searchsorted(doc, np.arange(n + 1))
    prev, after = np.full_like(own, 3 * ONE), np.full_like(own, 3 * ONE + 1)
    prev[1:], after[:-1] = own[:-1] + ONE, own[1:] + 2 * ONE
    begin = first_line[:-1][np.diff(first_line) > 0]
    prev[begin] = 3 * ONE
    last = first_line[1:][np.diff(first_line) > 0] - 1
    after[last] = 3 * ONE + 1
    return np.concatenate([own, prev, after], axis=1), first_line, chars


def running(m: np.ndarray, block: int = 64) -> np.ndarray:
    """Products m[0] @ ... @ m[i] of 2 x 2 matrices for every i, each up to a factor.
    Blocks advance together, and their products are treated in the same way."""
    n = len(m)
    if n <= 1:
        return m
    k = -(-n // block)
    out = np.empty((k, block, 2, 2))
    padded = out.reshape(-1, 2, 2)
    padded[:n], padded[n:] = m, np.eye(2)
    for j in range(1, block):
        x = out[:, j - 1] @ out[:, j]
        out[:, j] = x / x.max((1, 2), keepdims=True)
    if k > 1:
        before = running(out[:, -1].copy(), block)[:-1]
        x = before[:, None] @ out[1:]
        out[1:] = x / x.max((2, 3), keepdims=True)
    return out.reshape(-1, 2, 2)[:n]


def marginals(score: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on all chains at once. score: log weight of bad over good of
    each line; pair: 2 x 2 log weights of consecutive labels. Returns each line's
    probability of bad, and the expected count of each pair.

    A line's matrix holds the weights of its label after each label of the line before;
    that of a chain's first line has equal rows, so that a product over all lines of all
    chains starts anew there, and the work doesn't hang on the longest chain."""
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    node = np.stack([np.minimum(0, -score), np.minimum(0, score)], axis=1)
    begin = np.zeros(n, bool)
    begin[first[:-1][np.diff(first) > 0]] = True
    step = np.exp(np.maximum(node[:, None, :] + np.where(begin[:, None, None], 0.0, pair - pair.max()), -300))
    ahead = running(step)[:, 0]
    # Backwards: the products from the right, by transposed matrices in reverse order.
    back = np.ones((n, 2))
    if n > 1:
        back[:-1] = running(step[:0:-1].transpose(0, 2, 1))[::-1].sum(1)
    back /= back.max(1, keepdims=True)
    both = ahead * back
    inner = np.flatnonzero(~begin)
    joint = ahead[inner - 1][:, :, None] * step[inner] * back[inner][:, None, :]
    expected = (joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)).sum(0)
    return both[:, 1] / np.maximum(both.sum(1), 1e-300), expected


class Field:
    """The fitted field and curve."""

    def __init__(self):
        self.weights, self.pair, self.curve = np.zeros(WIDTH), np.zeros((2, 2)), np.array([0.0, 0.0])

    def emission(self, x: np.ndarray) -> np.ndarray:
        return sum((self.weights[x[:, j]] for j in range(1, x.shape[1])), self.weights[x[:, 0]]) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, first: np.ndarray, bad: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> None:
        """Likelihood ascent with adaptive steps (Adam)."""
        m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
        inner = np.ones(len(bad), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        b = bad.astype(int)
        at = np.flatnonzero(inner)
        pairs = np.bincount(b[at - 1] * 2 + b[at], minlength=4).reshape(2, 2)
        for step in range(1, rounds + 1):
            p, expected = marginals(self.emission(x), self.pair, first)
            g = np.concatenate([sum(np.bincount(x[:, j], b - p, minlength=WIDTH) for j in range(x.shape[1])), (pairs - expected).ravel()]) / max(1, len(b))
            g -= decay * np.concatenate([self.weights, self.pair.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.weights += move[:WIDTH]
            self.pair += move[WIDTH:].reshape(2, 2)

    def badness(self, x: np.ndarray, first: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Share of each text that is bad; a text without lines is all bad."""
        p, _ = marginals(self.emission(x), self.pair, first)
        total = np.concatenate([[0], np.cumsum(chars)])
        bad = np.concatenate([[0], np.cumsum(chars * p)])
        size = total[first[1:]] - total[first[:-1]]
        return np.where(size > 0, (bad[first[1:]] - bad[first[:-1]]) / np.maximum(size, 1), 1.0)

    def score(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * share)))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("good", pa.int32()), ("x", pa.binary()), ("chars", pa.binary())])
    for b in batches:
        for t in chunks(b.column("text")):
            x, first, chars = lines(t)
            rows = [(x[lo:hi].astype(np.int16).tobytes(), chars[lo:hi].tobytes()) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield batch(schema, b.column("doc_id").slice(t.lo, len(t)), b.column("good").slice(t.lo, len(t)), [r[0] for r in rows], [r[1] for r in rows])


def held_out(doc_id, folds: int = FOLDS):
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def sampled(docs: DataFrame, known: DataFrame, label: str, rows: int, size: int) -> DataFrame:
    """doc_id, text and label of labelled documents (known: doc_id, label 0 or 1): of
    either label the first by hash of the id, up to half of rows and, but for the first
    of them, half of size bytes. Texts are whole; of null texts nothing is learned."""
    half = [known.filter(F.col(label) == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for g in (0, 1)]
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(half[0].union(half[1])), "doc_id")
    sizes = texts.select("doc_id", label, F.octet_length("text").alias("n")).groupBy("doc_id", label).agg(F.sum("n").alias("n")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").collect()
    chosen: list[int] = []
    for g in (0, 1):
        left = size // 2
        for i, r in enumerate(x for x in sizes if x[label] == g):
            left -= r.n
            if left < 0 and i:
                break
            chosen.append(r.doc_id)
    if len(chosen) == len(sizes):
        return texts
    kept = docs.sparkSession.createDataFrame([(x,) for x in chosen], "doc_id long")
    return texts.join(F.broadcast(kept), "doc_id", "left_semi")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """The field, from labels (doc_id, quality) outside the held-out fold. Labels that
    are null are ignored; of several for a document the mean decides. Without labels of
    both kinds the field knows nothing and all texts score alike."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    texts = sampled(docs, known, "good", sample, SAMPLE_BYTES)
    rows = sorted(texts.mapInArrow(_features, "doc_id long, good int, x binary, chars binary").collect())
    field = Field()
    good = np.array([r[1] for r in rows], np.int64)
    if not len(rows) or good.min() == good.max():
        return field
    x = np.concatenate([np.frombuffer(r[2], np.int16).reshape(-1, 3 * len(LIMITS)) for r in rows])
    chars = np.concatenate([np.frombuffer(r[3], np.float64) for r in rows])
    first = np.concatenate([[0], np.cumsum([len(r[3]) // 8 for r in rows])])
    bad = np.repeat(1 - good, np.diff(first)).astype(bool)
    field.fit(x, first, bad)
    # Lines of bad documents that look good are good, but for each one's worst line.
    p, _ = marginals(field.emission(x), field.pair, first)
    own = field.emission(x)
    doc = np.repeat(np.arange(len(rows)), np.diff(first))
    worst = np.full(len(rows), -np.inf)
    np.maximum.at(worst, doc, own)
    field.fit(x, first, bad & ((p > 0.3) | (own >= worst[doc])))
    share = field.badness(x, first, chars)
    a = np.array([0.0, 0.0])
    design = np.stack([np.ones(len(share)), share], axis=1)
    weight = np.where(good == 1, 0.5 / max(1, (good == 1).sum()), 0.5 / max(1, (good == 0).sum())) * len(good)
    for _ in range(60):  # Newton's steps for the curve
        p = 1 / (1 + np.exp(-design @ a))
        g = design.T @ (weight * (good - p)) - 0.5 * a
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2)
        a = a + np.clip(np.linalg.solve(hess, g), -5, 5)
    field.curve = a
    return field


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_lines", pa.int64()), ("bad_share", pa.float64())])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, quality, ...) -> doc_id, held_out, score
    (0 to 1, higher: better), predicted, n_lines, bad_share.

    A row for each row, repeated ones too, each scored on its whole text however long.
    Null and empty texts have no lines; they score as wholly bad. An empty table gives
    an empty result; without labels all texts score alike. Other columns, of any name,
    are ignored."""
    field = fitted(docs, labels)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(b.column("text")):
                x, first, chars = lines(t)
                share = field.badness(x, first, chars)
                s = field.score(share)
                yield batch(SCORED, b.column("doc_id").slice(t.lo, len(t)), b.column("held_out").slice(t.lo, len(t)), s, (s >= threshold).astype(np.int32), np.diff(first).astype(np.int64), share)

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(step, "doc_id long, held_out boolean, score double, predicted int, n_lines long, bad_share double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns of whatever names, that score at least threshold, by
    their whole texts. Null and empty texts score as wholly bad; repeated rows and those
    of null or shared ids are judged each by its own text; an empty table stays empty."""
    field = fitted(docs, labels)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [np.zeros(0, bool)]
            for t in chunks(b.column("text")):
                keep.append(field.score(field.badness(*lines(t))) >= threshold)
            yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(step, docs.schema)
