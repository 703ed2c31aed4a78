"""Exact token counts at every prefix by dynamic programming.

Byte-pair encoding splits a text into pieces and encodes each piece alone. Within a
piece, the encoding of a prefix is the encoding of a shorter prefix plus one token:
of the vocabulary's tokens that end there, exactly one is such that it and the shorter
prefix's last token are what their joined bytes encode to. So one pass over the bytes
gives the last token, and with it the count, of every prefix. A text's counts at piece
ends are running sums; within a piece the piece's own row of counts is added. A cut or
a budget is then a binary search and never encodes anything again.

Texts are cut into pieces and these told apart by hash, many texts at once; each
distinct piece's row is made once for a worker."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vaultframe.llm.common import CHUNK_BYTES, GOLD, U, Texts, batch, chunks, hashes, mix64

LIMIT = 512
#: How byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond those whose classes have long been settled.
LATER = regex.compile(r"[^\x00-\u052F\u1E00-\u1FFF\u2010-\u2060]")
#: Code points from here on are left to the library's own classes.
SETTLED = 0x2061
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Distinct pieces that a worker remembers.
REMEMBERED = 300_000


def _byte_names() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


class PrefixCounter:
    """Counts for one vocabulary file (.json, byte-level BPE). Counts are those of the
    tokenizers library with add_special_tokens=False."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"not a byte-level BPE vocabulary: {path}")
        of = _byte_names()
        raw = lambda s: bytes(of[c] for c in s)
        self.rank = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((raw(a), raw(b)), i)
        self.vocab = {raw(k) for k in spec["model"]["vocab"] if all(c in of for c in k)}
        self.longest = max(map(len, self.vocab))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # How each token that merging can reach is made: the merge's rank, and its halves.
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {t: (-1, b"", b"") for t in self.vocab if len(t) == 1}
        for (a, b), i in sorted(self.rank.items(), key=lambda x: x[1]):
            if a in self.made and b in self.made and a + b in self.vocab:
                self.made.setdefault(a + b, (i, a, b))
        self.library = None
        self.path = path
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._counts: dict[str, int] = {}
        self._by_hash: dict[int, int] = {}
        points = [chr(i) for i in range(SETTLED + 1)]
        self.kind = np.array([LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else SPACE if regex.match(r"\s", c) else OTHER for c in points], np.uint8)
        self.later = np.array([bool(LATER.match(c)) for c in points])
        self.later[SETTLED] = True
        self.symbol = mix64(np.arange(1, SETTLED + 2, dtype=U) * GOLD)

    def encode(self, piece: bytes) -> list[bytes]:
        """Merges by rank, for short byte strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == pair[0] and parts[i + 1] == pair[1]:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens side by side stay as they are. Their making is undone from
        the last merge on: had the tokens that met at the border at some time a merge
        of a rank below the merges that took them away, it would have come first."""
        got = self._fits.get((a, b))
        if got is not None:
            return got
        if len(self._fits) > REMEMBERED:
            self._fits.clear()
        made, rank = self.made, self.rank
        x, y, x_goes, y_goes, got = a, b, 1 << 60, 1 << 60, True
        while True:
            m = rank.get((x, y))
            if m is not None and m < x_goes and m <= y_goes:
                got = False
                break
            (i, _, right), (j, left, _) = made[x], made[y]
            if i < 0 and j < 0:
                break
            if i > j:
                x, x_goes = right, i
            else:
                y, y_goes = left, j
        self._fits[a, b] = got
        return got

    def row(self, piece: bytes) -> list[int]:
        """Token counts of the piece's prefixes of 0, 1, ... bytes."""
        n = len(piece)
        counts, last = [0] * (n + 1), [b""] * (n + 1)
        made, fits, longest = self.made, self.fits, self.longest
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):  # the longest token first
                t = piece[j:i]
                if t in made and (j == 0 or fits(last[j], t)):
                    counts[i], last[i] = counts[j] + 1, t
                    break
        return counts

    def count(self, piece: str) -> int:
        got = self._counts.get(piece)
        if got is None:
            if len(self._counts) > REMEMBERED:
                self._counts.clear()
            got = self._counts[piece] = self.row(piece.encode())[-1]
        return got

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        if self.cut:
            for m in self.cut.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        if at < len(text):
            yield text[at:], False

    def split(self, part: str) -> list[str]:
        """The pieces. Character classes of scripts that Unicode still adds to are the
        library's."""
        if not LATER.search(part):
            return self.pieces.findall(part)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [part[lo:hi] for _, (lo, hi) in self.library.pre_tokenize_str(part)]

    def ends(self, text: str) -> tuple[list[str], np.ndarray]:
        """The text's pieces and the token count at each one's end."""
        names: list[str] = []
        counts: list[int] = []
        known = self._counts
        for part, special in self._parts(text):
            if special:
                names.append(part)
                counts.append(1)
                continue
            found = self.split(part)
            names += found
            try:
                counts += [known[x] for x in found]
            except KeyError:
                counts += [self.count(x) for x in found]
        return names, np.cumsum(np.array(counts, np.int64))

    def total(self, text: str) -> int:
        _, c = self.ends(text)
        return int(c[-1]) if len(c) else 0

    def prefixes(self, text: str) -> np.ndarray:
        """Token count of text[:i] for every i, as the library gives it for that prefix
        alone."""
        out = np.zeros(len(text) + 1, np.int64)
        at = base = 0
        tail, tail_base = "", 0  # what of the pieces before a special string its prefix would join
        for part, special in self._parts(text):
            if special:  # cut within, its characters are ordinary text
                joined = self._plain(tail + part[:-1])
                out[at + 1 : at + len(part)] = tail_base + joined[len(tail) + 1 :]
                base += 1
                out[at + len(part)] = base
                tail, tail_base = "", base
            else:
                row = self._plain(part)
                out[at + 1 : at + len(part) + 1] = base + row[1:]
                tail, tail_base = part, base
                base += int(row[-1])
            at += len(part)
        return out

    def _plain(self, part: str) -> np.ndarray:
        out = np.zeros(len(part) + 1, np.int64)
        at = base = 0
        for piece in self.split(part):
            raw = piece.encode()
            size = np.cumsum([0, *(len(c.encode()) for c in piece)])
            row = np.array(self.row(raw), np.int64)[size]
            if piece in ("'re", "'ve", "'ll"):  # cut after the letter it is a mark and a letter
                row[2] = 2
            out[at + 1 : at + len(piece) + 1] = base + row[1:]
            at += len(piece)
            base += int(row[-1])
        # Prefixes that end within a run of white space: the run so far is one piece.
        for m in regex.finditer(r"\s+", part):
            lo, hi = m.span()
            if hi - lo > 1:
                start = int(out[lo])
                sizes = np.cumsum([len(c.encode()) for c in m[0]])
                row = self.row(m[0].encode())
                for k in range(lo + 1, hi + 1):
                    out[k] = start + row[int(sizes[k - lo - 1])]
        return out

    def fitting(self, text: str, limit: int = LIMIT) -> int:
        """Characters of the longest prefix that has at most limit tokens."""
        names, c = self.ends(text)
        k = int(np.searchsorted(c, limit, "right"))
        if k == len(names):
            return len(text)
        while names[k].isspace() and k + 1 < len(names):
            k += 1
        row = self.prefixes(text[: sum(map(len, names[: k + 1]))])
        return int(np.flatnonzero(row <= limit)[-1])

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start in the joined code points of some texts (which start at
        first), none of them of a later script."""
        n = len(points)
        kind = self.kind[points]
        new = np.zeros(n + 3, bool)
        new[first] = True
        fresh = new[:n].copy()
        space = kind == SPACE
        # A piece ends where the class changes, but one space goes with what follows.
        new[1:n] |= (kind[1:] != kind[:-1]) & ~(space[:-1] & ~space[1:] & (points[:-1] == 0x20))
        # The last of several spaces before something else is apart from the others.
        last = np.flatnonzero(space[1:-1] & space[:-2] & ~space[2:] & ~fresh[2:] & ~fresh[1:-1]) + 1
        new[last] = True
        # Contractions: a mark that starts a piece, and letters after it in its text.
        mark = np.flatnonzero((points == 0x27) & new[:n])
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        inside = np.concatenate([~fresh, np.zeros(3, bool)])
        one, two = padded[mark + 1], padded[mark + 2]
        short = inside[mark + 1] & np.isin(one, [ord(c) for c in "stmd"])
        pair = (one.astype(np.int64) << 16) | two
        long = inside[mark + 1] & inside[mark + 2] & np.isin(pair, [ord(x) << 16 | ord(y) for x, y in ("re", "ve", "ll")])
        new[mark[short | long] + 1] = False
        new[mark[short] + 2] = True
        new[mark[long] + 3] = True
        return np.flatnonzero(new[:n])

    def measured(self, t: Texts, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, pieces and fitting characters of each text."""
        if len(t) == 1 and len(t.data) > 2 * CHUNK_BYTES:
            return self._long(t, limit)
        n = len(t)
        raw = t.data.tobytes().decode()
        points = np.minimum(np.frombuffer(raw.encode("utf-32-le"), np.uint32), SETTLED)
        offs = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])[t.offs]
        slow = np.zeros(n, bool)
        odd = np.flatnonzero(self.later[points])
        if self.cut:
            odd = np.concatenate([odd, np.array([m.start() for m in self.cut.finditer(raw)], np.int64)])
        slow[np.searchsorted(offs, odd, "right") - 1] = True
        at = self.starts(points, offs[:-1][np.diff(offs) > 0]) if len(points) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(points))[: len(at)]
        h, index, which = np.unique(hashes(points, at, ends, self.symbol), return_index=True, return_inverse=True)
        known = self._by_hash
        if len(known) > REMEMBERED:
            known.clear()
        each = np.zeros(len(h), np.int64)
        a, z = at[index].tolist(), ends[index].tolist()
        for i, x in enumerate(h.tolist()):
            got = known.get(x)
            if got is None:
                got = known[x] = self.count(raw[a[i] : z[i]])
            each[i] = got
        total = np.concatenate([[0], np.cumsum(each[which])])
        first = np.searchsorted(at, offs)
        tokens, pieces, fit = total[first[1:]] - total[first[:-1]], np.diff(first), np.diff(offs)
        for i in np.flatnonzero((tokens > limit) & ~slow).tolist():
            lo, hi = int(first[i]), int(first[i + 1])
            k = int(np.searchsorted(total[lo + 1 : hi + 1], total[lo] + limit, "right")) + lo
            j, m = k, k  # with the white space around, of which a prefix may end within
            while j > lo and raw[at[j - 1] : ends[j - 1]].isspace():
                j -= 1
            while m + 1 < hi and raw[at[m] : ends[m]].isspace():
                m += 1
            row = int(total[j] - total[lo]) + self._plain(raw[at[j] : ends[m]])
            fit[i] = at[j] - offs[i] + np.flatnonzero(row <= limit)[-1]
        for i in np.flatnonzero(slow).tolist():
            text = raw[offs[i] : offs[i + 1]]
            names, c = self.ends(text)
            tokens[i], pieces[i], fit[i] = int(c[-1]) if len(c) else 0, len(names), self.fitting(text, limit)
        return tokens, pieces, fit

    def _long(self, t: Texts, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One long text, in parts: no piece runs on from something that isn't white
        space to white space."""
        data = t.data
        if self.cut and self.cut.search(data.tobytes().decode()):
            text = data.tobytes().decode()
            names, c = self.ends(text)
            return np.array([c[-1]]), np.array([len(names)]), np.array([self.fitting(text, limit)])
        blank = (data == 0x20) | ((data >= 9) & (data <= 13))
        cuts = [0]
        can = np.flatnonzero(blank[1:] & ~blank[:-1] & (data[:-1] < 0x80) & ~((data[:-1] >= 0x1C) & (data[:-1] <= 0x1F))) + 1
        while cuts[-1] < len(data):
            x = np.searchsorted(can, cuts[-1] + CHUNK_BYTES)
            cuts.append(int(can[x]) if x < len(can) else len(data))
        sums, fit, open_ = np.zeros(2, np.int64), 0, True
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            # Two rows of one part keep it from being taken for a long text again.
            tokens, pieces, f = self.measured(Texts(data[lo:hi], np.array([0, hi - lo, hi - lo]), 0, 2), max(0, limit - int(sums[0])))
            if open_:
                fit += int(f[0])
                open_ = sums[0] + tokens[0] <= limit
            sums += int(tokens[0]), int(pieces[0])
        return sums[:1], sums[1:], np.array([fit])


_LOADED: dict[str, PrefixCounter] = {}


def loaded(path: str) -> PrefixCounter:
    """One counter for each file and worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_pieces", pa.int64()), ("fitting_chars", pa.int64())])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_tokens, over_limit (more than limit
    tokens), n_pieces, fitting_chars (characters of the longest prefix that has at most
    limit tokens).

    path: the vocabulary file, at the same place on every executor. A row for each row,
    repeated ones too, of whole texts however long; a null text counts as empty, with no
    tokens; an empty table gives an empty result. Of prefixes with equally many tokens
    the longest counts. Special strings within a text count as one token, as the
    library's default has it. Other columns, of any name, are ignored."""
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for b in batches:
            ids = b.column("doc_id")
            for t in chunks(b.column("text")):
                n, pieces, fit = counter.measured(t, limit)
                yield batch(COUNTED, ids.slice(t.lo, len(t)), np.diff(t.offs), n, n > limit, pieces, fit)

    return docs.select("doc_id", "text").mapInArrow(step, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_pieces long, fitting_chars long")


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, counts: the token count of the text's prefix of
    0, 1, ... characters, so that counts[k] answers what a cut after k characters leaves.
    Null texts count as empty and have the one count 0; otherwise as token_counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("counts", pa.list_(pa.int32()))])

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for b in batches:
            for t in chunks(b.column("text")):
                yield batch(schema, b.column("doc_id").slice(t.lo, len(t)), [counter.prefixes(t.text(i).decode()) for i in range(len(t))])

    return docs.select("doc_id", "text").mapInArrow(step, "doc_id long, counts array<int>")
