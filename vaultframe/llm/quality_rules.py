"""Quality rules by distribution divergence.

The corpus gives each language two references: the shares of character classes, and
those of its common words. A document is held against every language by the
Jensen-Shannon distance of both histograms and judged by the nearest; texts too short
for a histogram to mean anything are spared the divergence rules."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.llm.common import WHITE, U, Words, batch, chunks, hashes, symbols, windows, written

#: Common words of a language.
COMMON = 64
#: Counts of common words, over all languages, that one numpy step holds.
CELLS = 4_000_000
#: Words from which the word histogram counts, and the character histogram.
MIN_WORDS, MIN_CHAR_WORDS = 60, 20
#: Largest Jensen-Shannon distance (0 to 1) from the nearest language.
MAX_CHAR, MAX_WORD = 0.33, 0.46

#: Class of each byte: lower, upper, digit, white, stop, other ASCII, beyond ASCII; a
#: continuation byte has none.
CLASSES = 7
_CLASS = np.full(256, 5, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[WHITE] = 3
_CLASS[[*b".,;:!?'\"()-"]] = 4
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 6, 7
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_PLAIN = np.arange(256, dtype=np.uint8)


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def char_classes(t) -> np.ndarray:
    doc = np.repeat(np.arange(len(t)), np.diff(t.offs))
    return np.bincount(doc * (CLASSES + 1) + _CLASS[t.data], minlength=len(t) * (CLASSES + 1)).reshape(len(t), -1)[:, :CLASSES]


def base_rules(t, w: Words) -> dict[str, np.ndarray]:
    n = len(t)
    data = t.data
    out = {"n_words": np.diff(w.first), "word_chars": _sums(((data & 0xC0) != 0x80) & ~WHITE[data], t.offs), "n_symbols": _sums(_SYMBOL[data], t.offs)}
    # Lines: cut at \n and at texts' ends.
    cut = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([t.offs[:-1], cut + 1]))
    starts = starts[starts < len(data)]
    doc = np.searchsorted(t.offs, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), t.offs[doc + 1])
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10))
    seen = np.concatenate([[0], np.cumsum(~WHITE[data], dtype=np.int64)])
    some = seen[ends] > seen[starts]
    h, doc = hashes(data, starts[some], ends[some], symbols(_PLAIN, 7)), doc[some]
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][same], minlength=n)
    # Words in windows of eight that occur again.
    g = windows(w.hash, 8)
    ok = np.flatnonzero(w.doc[7:] == w.doc[: len(g)]) if len(g) else np.zeros(0, np.int64)
    g = g[ok] ^ (w.doc[ok].astype(U) << U(48))
    order = np.argsort(g)
    s = g[order]
    again = np.zeros(len(s), bool)
    if len(s):
        same = s[1:] == s[:-1]
        again[1:] |= same
        again[:-1] |= same
    edge = np.zeros(len(w.starts) + 9, np.int64)
    at = ok[order[again]]
    edge[at] += 1
    np.subtract.at(edge, at + 8, 1)
    out["n_repeat_words"] = _sums(np.cumsum(edge)[: len(w.starts)] > 0, w.first)
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of histograms along the last axis; against
    nothing it is 0."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(-1)
        return np.where(p.sum(-1) > 0, np.sqrt(np.maximum(0, (kl(p) + kl(q)) / 2)), 0.0)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: -1 - class with its characters, and words' hashes with their counts."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])
    for b in batches:
        lang = b.column("lang").dictionary_encode()
        names, code = lang.dictionary.to_pylist(), lang.indices.fill_null(len(lang.dictionary)).to_numpy(zero_copy_only=False)
        for t in chunks(b.column("text")):
            w = Words(t, ~WHITE, symbols())
            own, c = code[t.lo : t.hi], char_classes(t)
            for k in np.unique(own).tolist():
                name = names[k] if k < len(names) else None
                h, n = np.unique(w.hash[(own == k)[w.doc]], return_counts=True)
                yield batch(schema, [name] * (CLASSES + len(h)), np.concatenate([np.zeros(CLASSES, np.int32), np.ones(len(h), np.int32)]), np.concatenate([np.arange(CLASSES), h.view(np.int64)]), np.concatenate([c[own == k].sum(0), n]))


def references(docs: DataFrame, common: int = COMMON) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per language: character class counts, hashes and counts of its common words, and
    its number of words. Rows without a lang are a language of their own."""
    n = docs.select("lang", "text").mapInArrow(_counts, "lang string, kind int, h long, n long").groupBy("lang", "kind", "h").agg(F.sum("n").alias("n"))
    n = written(n, "histograms")
    total = n.filter("kind = 1").groupBy("lang").agg(F.sum("n").alias("words"))
    top = n.filter("kind = 1").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))).filter(F.col("r") <= common)
    rows = n.filter("kind = 0").select("lang", "kind", "h", "n").union(top.select("lang", "kind", "h", "n")).union(total.select("lang", F.lit(2), F.lit(0), "words")).collect()
    by: dict[str | None, list] = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = []
    for lang in sorted({r[0] for r in rows if r[1] == 2}, key=str):
        own = by[lang]
        chars = np.zeros(CLASSES, np.int64)
        for r in own:
            if r[1] == 0:
                chars[r[2]] = r[3]
        words = sorted((r[2], r[3]) for r in own if r[1] == 1)
        out.append((chars, np.array([x[0] for x in words], np.int64).view(U), np.array([x[1] for x in words], np.int64), next(r[3] for r in own if r[1] == 2)))
    return out


JUDGED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])


def judged(docs: DataFrame, common: int = COMMON, max_char: float = MAX_CHAR, max_word: float = MAX_WORD) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> the base measures, base_failed, kept and the
    distances from the nearest language.

    A row for each row, repeated ones too, of whole texts however long. Null and empty
    texts have no words: they fail the base rules. Of common words in equal number those
    of the least hash are taken.
    Texts of few words are spared the divergence rules. Without any reference (an empty
    table) nothing is returned. Other columns are ignored."""
    refs = references(docs, common)
    table = np.unique(np.concatenate([r[1] for r in refs])) if refs else np.zeros(0, U)
    columns = [np.searchsorted(table, r[1]) for r in refs]
    shares = [np.append(r[2], r[3] - r[2].sum()).astype(float) for r in refs]
    chars = [r[0].astype(float) for r in refs]

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for t in chunks(b.column("text")):
                n = len(t)
                w = Words(t, ~WHITE, symbols())
                base = base_rules(t, Words(t, ~WHITE, symbols(_PLAIN, 3)))
                char = np.min([distance(char_classes(t).astype(float), c) for c in chars], axis=0) if chars else np.zeros(n)
                word = np.zeros(n)
                size = max(1, CELLS // max(1, len(table)))
                for lo in range(0, n if len(table) else 0, size):
                    hi = min(n, lo + size)
                    own_words = slice(w.first[lo], w.first[hi])
                    at = np.searchsorted(table, w.hash[own_words]).clip(max=len(table) - 1)
                    hit = table[at] == w.hash[own_words]
                    counts = np.bincount((w.doc[own_words][hit].astype(np.int64) - lo) * len(table) + at[hit], minlength=(hi - lo) * len(table)).reshape(hi - lo, -1)
                    each = []
                    for c, s in zip(columns, shares, strict=True):
                        own = counts[:, c]
                        each.append(distance(np.concatenate([own, (base["n_words"][lo:hi] - own.sum(1))[:, None]], axis=1).astype(float), s))
                    word[lo:hi] = np.min(each, axis=0)
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                fine = ((base["n_words"] < MIN_CHAR_WORDS) | (char <= max_char)) & ((base["n_words"] < MIN_WORDS) | (word <= max_word))
                yield batch(JUDGED, ids.slice(t.lo, n), *base.values(), failed, ~failed & fine, char, word)

    return docs.select("doc_id", "text").mapInArrow(step, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double")
