"""Language-model scores from a hierarchical Pitman-Yor model of words.

Every preceding word is a context with a restaurant of its own, in which the words that
follow it in the training documents sit; all of them share one parent, the restaurant of
the corpus, whose customers are the tables of its children; its new tables order words
from the spelling model, which writes them letter by letter from restaurants whose
context is up to ORDER letters before, each sharing a parent with all contexts of the
same last letters. The end of a text is one more word, its beginning one more context.

Seating is sampled by Gibbs: in turn, the customers of a dish in a restaurant leave and
sit down again, at a new table with the mass that the parent's probability gives it, all
else being as the sweep before left it. Only how many tables serve each dish matters, so
that is what is kept; customers beyond the first few sit down in blocks. Tables are
averaged over the samples, in which predictive probabilities are linear, so that these
still sum to one. A dish with one customer has one table and needs no sampling.

All of this grows with the corpus and is held by shuffled tables. Tasks hold the
statistics of the NUMBERED most frequent words. Texts are kept as these words' numbers;
each chunk of texts asks for its distinct pairs, packed and dealt by hash to buckets that
count and seat them, and gets its answers by the same way. A pair that occurs once in the
corpus needs no answer: its chunk knows all there is. Pairs with any other word travel as
rows and get their words' statistics by joins; those that occur more than once are
seated in every sweep like the others, gathered by the word that has no number. Both ways
lead to the same formula and the same seating."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import GOLD, WHITE, U, Words, batch, chunks, done, groups, mix64, packs, symbols, written

#: Letters of context; words that have numbers; Gibbs sweeps, and those before the first
#: sample; tokens for each of which there is a bucket of pairs.
ORDER, NUMBERED, SWEEPS, BURN, BUCKET = 3, 1_000_000, 3, 1, 2_000_000
#: Bits of a number, and the number of words that have none.
BITS, NONE = 20, (1 << 20) - 1
FOLDS = 10
#: Discount and concentration of words' contexts, of the corpus, and of spelling levels.
PAIR, WORD, LEVELS = (0.8, 1.0), (0.7, 100.0), ((0.2, 1.0), (0.4, 1.0), (0.5, 1.0), (0.6, 1.0), (0.7, 1.0))
#: The word that ends a text, which no text has as a word, and how likely the spelling
#: model holds it; bytes that stand before and after a word's letters, which UTF-8
#: never uses.
END, ENDING, BEFORE, AFTER = "\n", 1e-7, b"\xfe", 0xFF
#: Hashes of the end and the beginning of a text.
END_HASH, BEGIN_HASH = U(0xE0D0), U(0xBE61)
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_SYMBOLS = symbols()
#: Bytes of text that one step takes, and tokens that make a chunk.
STEP, CHUNK = 2 << 20, 1_500_000


def words(raw: bytes) -> list[bytes]:
    """bytes.split() cuts at 0x20 and 0x09-0x0D."""
    return raw.translate(_LOWER).split()


def seat(rng: np.random.Generator, customers: np.ndarray, mass: np.ndarray, above: np.ndarray, discount: float) -> np.ndarray:
    """Tables of each dish after its customers sat down one after another. mass: the
    concentration and the discounts of the restaurant's other tables; above: the
    parent's probability of the dish."""
    t = np.minimum(customers, 1).astype(np.float64)
    at = np.ones(len(customers))
    live = np.flatnonzero(customers > 1)
    while len(live):
        n, tables, c = at[live], t[live], customers[live]
        block = np.minimum(np.maximum(1, np.floor(n / 8)), np.ceil(c - n))
        new = (mass[live] + discount * tables) * above[live]
        got = rng.binomial(block.astype(np.int64), np.clip(new / (new + n - discount * tables), 0, 1))
        t[live] = tables + got
        at[live] = n + block
        live = live[at[live] < customers[live]]
    return t


class Spelling:
    """Restaurants by context; arrays over (context, letter) pairs, a level per context
    length. sample() is one state of the seating."""

    def __init__(self, pairs: dict[bytes, dict[int, float]], seed: int = 1):
        """pairs: for each kept context, what follows it and how often, not counting what
        a longer kept context has taken over."""
        self.rng = np.random.default_rng(seed)
        self.contexts = sorted(pairs, key=lambda c: (len(c), c))
        self.number = {c: i for i, c in enumerate(self.contexts)}
        self.parent = np.array([self.number[c[1:]] if c else -1 for c in self.contexts])
        self.length = np.array([len(c) for c in self.contexts])
        self.own = pairs

    def run(self, sweeps: int, burn: int) -> tuple[dict[int, float], list[float]]:
        """Averaged predictive probability of every (context << 8 | letter) seen, and of
        an unseen letter's share that falls to the parent, by context."""
        own: list[dict[int, float]] = [self.own[c] for c in self.contexts]
        # Slots: letters that come up in a context or below it.
        slots: list[set[int]] = [set(x) for x in own]
        for i in range(len(self.contexts) - 1, 0, -1):
            slots[self.parent[i]] |= slots[i]
        key = np.array([i << 8 | w for i, s in enumerate(slots) for w in sorted(s)], np.int64)
        where = {int(k): j for j, k in enumerate(key)}
        ctx, letter = key >> 8, key & 255
        up = np.array([where[int(self.parent[c]) << 8 | int(w)] if c else -1 for c, w in zip(ctx.tolist(), letter.tolist(), strict=True)], np.int64)
        base = np.array([own[c].get(w, 0.0) for c, w in zip(ctx.tolist(), letter.tolist(), strict=True)])
        level = self.length[ctx]
        depth = int(level.max(initial=0))
        by = [np.flatnonzero(level == d) for d in range(depth + 1)]
        d = np.array([LEVELS[min(x, len(LEVELS) - 1)][0] for x in level])
        theta = np.array([LEVELS[min(x, len(LEVELS) - 1)][1] for x in level])
        tables = np.zeros(len(key))
        n, m = len(self.contexts), len(key)
        p = np.full(m, 1 / 257)
        total, share = np.zeros(m), np.zeros(n)
        taken = 0
        for sweep in range(sweeps):
            customers = base.copy()
            for k in range(depth, -1, -1):  # longest contexts first: their tables are the parent's customers
                i = by[k]
                above = p[up[i]] if k else np.full(len(i), 1 / 257)
                seated = np.bincount(ctx[i], tables[i], minlength=n)[ctx[i]]
                tables[i] = seat(self.rng, customers[i], theta[i] + d[i] * np.maximum(0, seated - tables[i]), above, float(d[i[0]]) if len(i) else 0.0)
                if k:
                    np.add.at(customers, up[i], tables[i])
            for k in range(depth + 1):  # probabilities, shortest contexts first
                i = by[k]
                above = p[up[i]] if k else np.full(len(i), 1 / 257)
                all_c, all_t = np.bincount(ctx[i], customers[i], minlength=n), np.bincount(ctx[i], tables[i], minlength=n)
                c = ctx[i]
                p[i] = (np.maximum(0, customers[i] - d[i] * tables[i]) + (theta[i] + d[i] * all_t[c]) * above) / (theta[i] + all_c[c])
            if sweep >= burn:
                taken += 1
                total += p
                all_c, all_t = np.bincount(ctx, customers, minlength=n), np.bincount(ctx, tables, minlength=n)
                dd = np.array([LEVELS[min(x, len(LEVELS) - 1)] for x in self.length])
                share += (dd[:, 1] + dd[:, 0] * all_t) / (dd[:, 1] + all_c)
        return dict(zip(key.tolist(), (total / taken).tolist(), strict=True)), (share / taken).tolist()


def _lettered(names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each letter of some words, and of their ends: the word, the letter, the ORDER
    bytes before it as an integer, and how many of these are the word's or its beginning."""
    sizes = np.array([len(x) for x in names], np.int64) + 2
    data = np.frombuffer(b"".join(BEFORE + x + b"\xff" for x in names), np.uint8).astype(np.int64)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(np.arange(len(data)) > start)
    code = np.zeros(len(at), np.int64)
    for j in range(ORDER, 0, -1):
        code = code << 8 | data[np.maximum(at - j, 0)]
    return np.repeat(np.arange(len(names)), sizes)[at], data[at], code, np.minimum(at - start[at], ORDER)


class Speller:
    """Probability of a word's letters from the averaged tables. By length of context:
    the contexts that have a restaurant and the share that falls to their parent, and
    the letters seen in them with their probabilities."""

    def __init__(self, contexts: list[bytes], seen: dict[int, float], share: list[float]):
        self.levels = []
        code = lambda c: int.from_bytes(c, "big")
        at: list[list[tuple[int, float]]] = [[] for _ in range(ORDER + 1)]
        for i, p in seen.items():
            c = contexts[i >> 8]
            at[len(c)].append((code(c) << 8 | i & 255, p))
        for k in range(ORDER + 1):
            own = sorted((code(c), share[i]) for i, c in enumerate(contexts) if len(c) == k)
            letters = sorted(at[k])
            self.levels.append((np.array([c for c, _ in own], np.int64), np.array([x for _, x in own]), np.array([c for c, _ in letters], np.int64), np.array([x for _, x in letters])))

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        i = np.searchsorted(table, x).clip(max=len(table) - 1)
        return i, table[i] == x

    def letters(self, letter: np.ndarray, code: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Natural logs of letters' probabilities after contexts of ORDER bytes, of which
        the last length count."""
        out, scale, open_ = np.zeros(len(letter)), np.ones(len(letter)), np.arange(len(letter))
        for k in range(ORDER, -1, -1):
            contexts, share, seen, p = self.levels[k]
            here = open_[length[open_] >= k]
            context = code[here] & ((1 << 8 * k) - 1)
            i, known = self._find(contexts, context)
            j, met = self._find(seen, context << 8 | letter[here])
            met &= known
            out[here[met]] = np.log(scale[here[met]] * p[j[met]])
            scale[here[known & ~met]] *= share[i[known & ~met]]
            left = np.ones(len(out), bool)
            left[here[met]] = False
            open_ = open_[left[open_]]
        out[open_] = np.log(scale[open_] / 257)
        return out

    def logs(self, names: list[bytes]) -> np.ndarray:
        """Natural logs of the probabilities of words' letters and ends."""
        if not names:
            return np.zeros(0)
        word, letter, code, length = _lettered(names)
        return np.bincount(word, self.letters(letter, code, length), minlength=len(names))


WORDS = pa.schema([("h", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
PAIRS = pa.schema([("context", pa.binary()), ("letter", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of all texts, by hash, with how often training texts have them."""
    for b in batches:
        held = b.column("held_out").to_numpy(zero_copy_only=False)
        for t in chunks(b.column("text"), STEP):
            w = Words(t, ~WHITE, _SYMBOLS)
            learn = ~held[t.lo : t.hi]
            h, at, of = np.unique(w.hash, return_index=True, return_inverse=True)
            n = np.bincount(of, learn[w.doc], minlength=len(h)).astype(np.int64)
            raw = t.data.tobytes().translate(_LOWER)
            names = [raw[x:y].decode() for x, y in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
            yield batch(WORDS, np.append(h, END_HASH).view(np.int64), [*names, END], np.append(n, learn.sum()))


def _letters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, letter) of every word type, as often as tables would order the word:
    its count to the power of the corpus restaurant's discount."""

    def merged(parts):
        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(key))

    parts, held = [], 0
    for b in batches:
        names = [x.encode() for x in b.column("word").to_pylist()]
        n = np.maximum(1, np.round(np.power(b.column("n").to_numpy().astype(float), WORD[0])))
        n[[x == END.encode() for x in names]] = 0
        word, letter, code, length = _lettered(names)
        parts.append(((length << 32) | (code & ((1 << 8 * length) - 1)) << 8 | letter, n[word]))
        held += len(word)
        if held > 4_000_000:
            parts = [merged(parts)]
            held = len(parts[0][0])
    if parts:
        key, n = merged(parts)
        key, n = key[n > 0], n[n > 0]
        for i in range(0, len(key), 100_000):
            k = key[i : i + 100_000]
            contexts = [((x >> 8) & 0xFFFFFF).to_bytes(x >> 32, "big") for x in k.tolist()]
            yield batch(PAIRS, contexts, (k & 255).astype(np.int32), n[i : i + 100_000].astype(np.int64))


def speller_of(words: DataFrame, seed: int) -> Speller:
    """The spelling model of the types in words (word, n). Its contexts are those of up
    to ORDER bytes that occur: bounded by the alphabet, not by a number."""
    pairs = words.filter("n > 0").select("word", "n").mapInArrow(_letters, "context binary, letter int, n long").groupBy("context", "letter").agg(F.sum("n").alias("n")).toArrow()
    own: dict[bytes, dict[int, float]] = {b"": {}}
    for part in pairs.to_batches(10_000):
        for context, letter, n in zip(*(part.column(x).to_pylist() for x in ("context", "letter", "n")), strict=True):
            own.setdefault(context, {})[letter] = float(n)
            for k in range(1, len(context)):
                own.setdefault(context[k:], {})
    spelling = Spelling(own, seed)
    seen, share = spelling.run(SWEEPS, BURN)
    return Speller(spelling.contexts, seen, share)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def most(df: DataFrame, limit: int) -> Column:
    """Which rows of df have the largest n, as many as whole steps of 2 % give without
    passing limit. Only the steps' counts reach the driver, not each task's rows."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.02)))
    steps = sorted(df.groupBy(step.alias("s")).count().collect(), reverse=True)
    total, least = 0, None
    for s, n in steps:
        total += n
        if total > limit:
            break
        least = s
    return (F.col("n") > 0) & F.coalesce(step >= least, F.lit(False)) if least is not None else F.lit(False)


def predictive(c, t, own_t, own_c, above, level: tuple[float, float] = PAIR):
    """Probability of a dish with c customers at t tables, in a restaurant of own_c
    customers at own_t tables, if its parent gives the dish the probability above."""
    d, theta = level
    return (np.maximum(0.0, c - d * t) + (theta + d * own_t) * above) / (theta + own_c)


class Head:
    """Statistics of the numbered words: n, tables in the contexts they make (made) and
    in the contexts they come in (k, on the driver), and their probability in the corpus (p). The
    beginning of a text, a context alone, is one more."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        order = np.argsort(h)
        self.hash, self.n = h[order], n[order]
        size = len(h)
        self.made, self.k, self.p = np.zeros(size), None, np.zeros(size)

    def number(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words by hash, -1 for others."""
        at = np.searchsorted(self.hash, h).clip(max=max(0, len(self.hash) - 1))
        return np.where(self.hash[at] == h, at, -1) if len(self.hash) else np.full(len(h), -1)


SENT = pa.schema([("kind", pa.int32()), ("base", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("x", pa.float64()), ("u", pa.int64()), ("w", pa.int64()), ("f", pa.int64()), ("raw", pa.binary())])
SENT_SQL = "kind int, base long, row long, doc_id long, held_out boolean, n long, known long, x double, u long, w long, f long, raw binary"
DOC, CHAIN, PLAIN = range(3)


def _row(kind: int, size: int, **columns) -> pa.RecordBatch:
    out = []
    for f in SENT:
        x = kind if f.name == "kind" else columns.get(f.name)
        out.append(pa.nulls(size, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(np.full(size, x) if np.isscalar(x) else x, f.type))
    return pa.RecordBatch.from_arrays(out, schema=SENT)


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of some integers, one byte of all after another: of sorted or
    small ones most bytes are then alike, and pack well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplaned(raw: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :width] = x.T
    return out.view("<u8").reshape(-1)


def _sender(shared, tokens: int, types: int):
    """Each text as a row with what its numbered words tell; each chunk's words by number,
    after its texts' lengths << 1 | whether they are learned from; and pairs with a word
    that has no number as rows, n of which tells which has one (1: the first, 2: the
    second)."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        scale = np.log10(tokens + 0.1 * (types + 1))
        base_of = np.log10(head.n + 0.1) - scale
        base, held_texts = TaskContext.get().partitionId() << 40, 0
        begin, end = head.number(np.array([BEGIN_HASH, END_HASH])).tolist()
        lengths: list[np.ndarray] = []
        numbers: list[np.ndarray] = []

        def chain() -> pa.RecordBatch:
            x = np.concatenate(lengths)
            return _row(CHAIN, 1, base=base, n=len(x), raw=[planes(x, 4) + planes(np.concatenate(numbers), 3)])

        for b in batches:
            held = b.column("held_out").to_numpy(zero_copy_only=False)
            for t in chunks(b.column("text"), STEP):
                size, first = len(t), base + held_texts
                w = Words(t, ~WHITE, _SYMBOLS)
                n = np.diff(w.first)
                number = head.number(w.hash)
                # Words of each text with the end, and the beginning and words before them.
                after, before = np.insert(number, w.first[1:], end), np.insert(number, w.first[:-1], begin)
                doc = np.repeat(np.arange(size), n + 1)
                x = np.bincount(doc, np.where(after >= 0, base_of[after], 0.0), minlength=size)
                known = np.bincount(doc, (after >= 0) & (head.n[after] > 0), minlength=size).astype(np.int64)
                yield _row(DOC, size, base=base, row=first + np.arange(size), doc_id=b.column("doc_id").slice(t.lo, size), held_out=b.column("held_out").slice(t.lo, size), n=n + 1, known=known, x=x)
                learn = ~held[t.lo : t.hi]
                lengths.append((n + 1) << 1 | learn)
                numbers.append(np.where(after < 0, NONE, after).astype(np.uint32))
                rest = np.flatnonzero((before < 0) | (after < 0))
                if len(rest):
                    u, v = np.insert(w.hash, w.first[:-1], BEGIN_HASH)[rest], np.insert(w.hash, w.first[1:], END_HASH)[rest]
                    with np.errstate(over="ignore"):
                        name = mix64(u * GOLD + v) ^ doc[rest].astype(U)
                    _, one, times = np.unique(name, return_index=True, return_counts=True)
                    r = rest[one]
                    yield _row(PLAIN, len(r), base=base, row=first + doc[r], held_out=~learn[doc[r]], n=(before[r] >= 0) + 2 * (after[r] >= 0), u=u[one].view(np.int64), w=v[one].view(np.int64), f=times)
                held_texts += size
                if sum(map(len, numbers)) >= CHUNK:
                    yield chain()
                    base, held_texts, lengths, numbers = base + held_texts, 0, [], []
        if numbers:
            yield chain()

    return step


class Chain:
    """A chunk's pairs of numbered words: the text of each (doc), and the distinct ones
    (pair, sorted) with how often in learned texts (c) and in others (other), and their
    buckets."""

    def __init__(self, raw: bytes, size: int, begin: int, buckets: int):
        lengths = unplaned(raw[: 4 * size], 4)
        after = unplaned(raw[4 * size :], 3).astype(np.uint32)
        n = (lengths >> U(1)).astype(np.int64)
        learn = (lengths & U(1)).astype(bool)
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[(np.cumsum(n) - n)] = begin
        both = (before != NONE) & (after != NONE)
        self.size, self.doc = size, np.repeat(np.arange(size, dtype=np.int32), n)[both]
        self.each = before[both].astype(U) << U(BITS) | after[both]
        del before, after, both
        key = self.each << U(1) | learn[self.doc]
        key.sort()
        pair = key >> U(1)
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        self.pair = pair[new]
        learned = np.concatenate([[0], np.cumsum((key & U(1)).astype(np.int64))])
        ends = np.append(new[1:], len(key))[: len(new)]
        self.c = learned[ends] - learned[new]
        self.other = ends - new - self.c
        self.bucket = ((mix64(self.pair * GOLD) >> U(33)) % U(buckets)).astype(np.int64)

    def dealt(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket with its pairs' places, in order."""
        order = np.argsort(self.bucket, kind="stable")
        b = self.bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(b[a]), order[a:z]


ASKED = pa.schema([("bucket", pa.int64()), ("base", pa.int64()), ("raw", pa.binary())])


def _ask(begin: int, buckets: int, count: bool):
    """Chunks' distinct pairs by bucket; count: with how often they occur."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, size, raw in zip(b.column("base").to_pylist(), b.column("n").to_pylist(), b.column("raw"), strict=True):
                x = Chain(raw.as_py(), size, begin, buckets)
                rows = [(k, base, planes(x.pair[i], 5) + (planes(x.c[i], 4) + planes(x.other[i], 4) if count else b"")) for k, i in x.dealt()]
                for at in range(0, len(rows), 256):
                    yield batch(ASKED, *map(list, zip(*rows[at : at + 256], strict=True)))

    return step


#: Words by number, so many together, when tables are summed.
RANGE = 1 << 14
COUNTED = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("pairs", pa.binary()), ("c", pa.binary()), ("t", pa.binary()), ("mean", pa.binary())])
COUNTED_SQL = "kind int, id long, pairs binary, c binary, t binary, mean binary"
SEATED, ALONE = range(2)


def _ranged(made: np.ndarray, k: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sums by number, those that aren't 0, in ranges."""
    for i in range(0, len(made), RANGE):
        some = np.flatnonzero((made[i : i + RANGE] > 0) | (k[i : i + RANGE] > 0))
        if len(some):
            yield i // RANGE, some.astype("<u2").tobytes() + made[i + some].astype("<f4").tobytes() + k[i + some].astype("<f4").tobytes()


def _tally(size: int):
    """Each bucket's pairs that occur more than once, with their customers, from what
    chunks ask, sorted by bucket; and, summed for the task, the tables of those that
    occur once and are learned. One chunk's pairs after another are added, so that what
    is held grows with distinct pairs alone."""

    def merged(parts):
        pair, at = np.unique(np.concatenate([p for p, _, _ in parts]), return_inverse=True)
        return (pair, *(np.bincount(at, np.concatenate([x[j] for x in parts]), minlength=len(pair)).astype(np.int64) for j in (1, 2)))

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, k = np.zeros(size, np.float32), np.zeros(size, np.float32)
        for bucket, raws in _streamed(batches, "bucket"):
            parts, held = [], 0
            for raw in raws:
                n = len(raw) // 13
                parts.append((unplaned(raw[: 5 * n], 5), unplaned(raw[5 * n : 9 * n], 4), unplaned(raw[9 * n :], 4)))
                held += n
                if held > BUCKET // 2:
                    parts, held = [merged(parts)], 0
            pair, c, other = merged(parts)
            once = pair[(c == 1) & (other == 0)]
            np.add.at(made, (once >> U(BITS)).astype(np.int64), 1)
            np.add.at(k, (once & U(NONE)).astype(np.int64), 1)
            several = np.flatnonzero(c + other > 1)
            if len(several):
                pair, c = pair[several], c[several]
                yield batch(COUNTED, [SEATED], [bucket], [planes(pair, 5)], [planes(c, 5)], [np.minimum(c, 1).astype("<f4").tobytes()], [np.zeros(len(c), "<f4").tobytes()])
        for i, raw in _ranged(made, k):
            yield batch(COUNTED, [ALONE], [i], [raw], [None], [None], [None])

    return step


def _streamed(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(key, its raws) of rows sorted by key, without holding more than a batch."""
    rows = ((k, raw.as_py()) for b in batches for k, raw in zip(b.column(key).to_pylist(), b.column("raw"), strict=True))
    for k, same in groupby(rows, key=lambda x: x[0]):
        yield k, (raw for _, raw in same)


def _sides(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pair >> U(BITS)).astype(np.int64), (pair & U(NONE)).astype(np.int64)


def _sweep(shared, seed: int, keep: bool):
    """One sweep over the pairs of some buckets; keep: it is a sample."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        d, theta = PAIR
        for b in batches:
            for bucket, *cells in zip(b.column("id").to_pylist(), *(b.column(x).to_pylist() for x in ("pairs", "c", "t", "mean")), strict=True):
                u, w = _sides(unplaned(cells[0], 5))
                c, t, mean = unplaned(cells[1], 5).astype(float), np.frombuffer(cells[2], "<f4").astype(float), np.frombuffer(cells[3], "<f4")
                several = np.flatnonzero(c > 1)
                others = np.maximum(0.0, head.made[u[several]] - t[several])
                t[several] = seat(np.random.default_rng((seed, bucket)), c[several], theta + d * others, head.p[w[several]], d)
                yield batch(COUNTED, [SEATED], [bucket], [cells[0]], [cells[1]], [t.astype("<f4").tobytes()], [(mean + keep * t).astype("<f4").tobytes()])

    return step


RANGED = pa.schema([("id", pa.int64()), ("raw", pa.binary())])


def _sums(size: int, column: str):
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, k = np.zeros(size), np.zeros(size)
        for b in batches:
            for pairs, t in zip(b.column("pairs").to_pylist(), b.column(column).to_pylist(), strict=True):
                u, w = _sides(unplaned(pairs, 5))
                t = np.frombuffer(t, "<f4")
                np.add.at(made, u, t)
                np.add.at(k, w, t)
        for i, raw in _ranged(made, k):
            yield batch(RANGED, [i], [raw])

    return step


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges' sums, sorted by range, to one row for each."""
    for i, raws in _streamed(batches, "id"):
        out = np.zeros((2, RANGE))
        for raw in raws:
            n = len(raw) // 10
            at = np.frombuffer(raw, "<u2", n)
            out[0, at] += np.frombuffer(raw, "<f4", n, 2 * n)
            out[1, at] += np.frombuffer(raw, "<f4", n, 6 * n)
        yield batch(RANGED, [i], [out.tobytes()])


def _totals(ranges: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables by context and by word, from ranges (id, raw)."""
    got = ranges.repartition("id").sortWithinPartitions("id").mapInArrow(_added, "id long, raw binary").toArrow()
    out = np.zeros((2, size))
    for i, raw in zip(got.column("id").to_pylist(), got.column("raw").to_pylist(), strict=True):
        part = np.frombuffer(raw, float).reshape(2, RANGE)[:, : size - i * RANGE]
        out[:, i * RANGE : i * RANGE + part.shape[1]] = part
    return out[0], out[1]


def _summed(table: DataFrame, size: int, column: str, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Each task sends a sum for every number it meets, so there are only so many tasks."""
    return _totals(table.filter(F.col("kind") == SEATED).select("pairs", column).coalesce(tasks).mapInArrow(_sums(size, column), "id long, raw binary"), size)


#: Words that the driver seats at once.
SLICE = 1 << 16
SPELLED = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("made", pa.float64()), ("k", pa.float64()), ("s", pa.float64()), ("g", pa.float64())])


def _spell(shared, total: float, seed: int):
    """Words with the probability of their spelling (g) and their tables in the corpus (s)."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller: Speller = shared.value
        d, theta = WORD
        rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
        for b in batches:
            names = b.column("word").to_pylist()
            end = np.array([x == END for x in names], bool)
            g = np.where(end, ENDING, (1 - ENDING) * np.exp(np.maximum(-650.0, speller.logs([x.encode() for x in names]))))
            k = b.column("k").to_numpy()
            s = np.where(k > 0, seat(rng, np.maximum(1.0, k), np.full(len(k), theta + d * total), g, d), 0.0)
            yield batch(SPELLED, b.column("h"), b.column("n"), b.column("made"), b.column("k"), s, g)

    return step


MOVING = pa.schema([*((x, pa.int64()) for x in ("u", "w", "c", "side")), *((x, pa.float64()) for x in ("made", "k", "g", "s", "first_s", "t", "mean", "more_s", "mean_s", "p"))])
MOVING_SQL = "u long, w long, c long, side long, made double, k double, g double, s double, first_s double, t double, mean double, more_s double, mean_s double, p double"


def _reseat(shared, by: str, corpus: tuple[float, float], seed: tuple[int, int], keep: bool):
    """One sweep over pairs with words that have no number, sorted by their second word,
    or by their first: seats that word in the corpus, or sums its tables as a context;
    then the pairs for which all is known, others waiting for the other word. made and k
    are tables if every pair had one; more_s, in one row of each second word, its tables
    in the corpus beyond those it began with. corpus: all of its tables and customers."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        for g in packs(batches, by, 8 << 20):
            x = {f.name: g.column(f.name).to_numpy().copy() for f in MOVING}
            key, first, of = np.unique(x[by], return_index=True, return_inverse=True)
            rng = np.random.default_rng((*seed, int(key[0]) & (1 << 62) - 1))
            beyond = np.bincount(of, x["t"] - 1, minlength=len(key))
            if by == "w":
                d, theta = WORD
                k, spell, s = x["k"][first] + beyond, x["g"][first], x["s"][first]
                s = seat(rng, k, theta + d * np.maximum(0.0, corpus[0] - s), spell, d)
                x["p"], x["s"] = predictive(k, s, *corpus, spell, WORD)[of], s[of]
                x["more_s"] = np.zeros(len(of))
                x["more_s"][first] = s - x["first_s"][first]
                x["mean_s"] += keep * x["more_s"]
                now = np.flatnonzero(x["side"] == 1)
                made = head.made[head.number(x["u"][now].view(U))]
            else:
                now = np.arange(len(of))
                made = x["made"] + beyond[of]
                numbered = np.flatnonzero(x["side"] == 2)
                x["p"][numbered] = head.p[head.number(x["w"][numbered].view(U))]
            d, theta = PAIR
            x["t"][now] = seat(rng, x["c"][now], theta + d * np.maximum(0.0, made - x["t"][now]), x["p"][now], d)
            x["mean"][now] += keep * x["t"][now]
            yield batch(MOVING, *(x[f.name] for f in MOVING))

    return step


def _moving(rare: DataFrame, tail: DataFrame) -> DataFrame:
    """Pairs with words that have no number and more than one customer, at one table,
    with what their words are without them."""
    first, second = F.col("side") % 2 == 1, F.col("side") >= 2
    none = F.lit(0.0)
    pairs = rare.filter("c > 1").select("u", "w", "c", F.col("side").cast("long").alias("side"))
    pairs = pairs.filter(~first).join(tail.select(F.col("h").alias("u"), "made"), "u").unionByName(pairs.filter(first).withColumn("made", none))
    pairs = pairs.filter(~second).join(tail.select(F.col("h").alias("w"), "k", "g", "s"), "w").unionByName(pairs.filter(second).select("*", *(none.alias(x) for x in ("k", "g", "s"))))
    return written(pairs.select("u", "w", "c", "side", "made", "k", "g", "s", F.col("s").alias("first_s"), F.lit(1.0).alias("t"), none.alias("mean"), none.alias("more_s"), none.alias("mean_s"), none.alias("p")), "moving", "zstd")


class Rest:
    """The pairs of _moving() between sweeps, and what their tables beyond one each add to
    numbered words (made, k) and to the sums of the others (all_k, all_s)."""

    def __init__(self, rare: DataFrame, tail: DataFrame):
        self.tables = [_moving(rare, tail)]
        self.now = self.tables[0]
        self.some = bool(self.now.limit(1).count())
        self.made, self.k, self.all_k, self.all_s = 0.0, 0.0, 0.0, 0.0
        done(rare.sparkSession)

    def sweep(self, shared, head: Head, corpus: tuple[float, float], seed: tuple[int, int], keep: bool) -> None:
        if not self.some:
            return

        def pass_(df: DataFrame, by: str, other: str) -> DataFrame:
            return written(df.repartition(by).sortWithinPartitions(by, other).mapInArrow(_reseat(shared, by, corpus, seed, keep), MOVING_SQL), "moving", "zstd")

        ended = pass_(self.now.filter("side < 2"), "w", "u")
        begun = pass_(ended.filter("side = 0").unionByName(self.now.filter("side = 2")), "u", "w")
        self.now = ended.filter("side = 1").unionByName(begun)
        done(self.now.sparkSession, *self.tables)
        self.tables = [ended, begun]
        self.all_k, self.all_s = (float(x or 0.0) for x in self.now.filter("side < 2").agg(F.sum(F.col("t") - 1), F.sum("more_s")).first())
        self.made, self.k = (self._added(head, side, word) for side, word in ((1, "u"), (2, "w")))

    def _added(self, head: Head, side: int, word: str, value: str = "t - 1") -> np.ndarray:
        h, n = _gathered(self.now.filter(F.col("side") == side).groupBy(word).agg(F.sum(F.expr(value)).alias("more")).filter("more > 0"), (word, "more"))
        out = np.zeros(len(head.hash))
        out[head.number(h.view(U))] = n
        return out

    def averaged(self, rare: DataFrame, tail: DataFrame, head: Head, samples: int) -> tuple[DataFrame, DataFrame]:
        """rare with t, the mean tables of its pairs, and tail with means; made, k and the
        sums become means, too."""
        fixed = rare.filter("c <= 1").select("u", "w", "c", "side", F.col("c").cast("double").alias("t"))
        if not self.some:
            return fixed, tail
        more = f"mean / {samples} - 1"
        self.made, self.k = (self._added(head, side, word, more) for side, word in ((1, "u"), (2, "w")))
        self.all_k, self.all_s = (float(x or 0.0) for x in self.now.filter("side < 2").agg(F.sum(F.expr(more)), F.sum(F.col("mean_s") / samples)).first())
        made = self.now.filter("side <> 1").groupBy(F.col("u").alias("h")).agg(F.sum(F.expr(more)).alias("more_made")).filter("more_made > 0")
        k = self.now.filter("side < 2").groupBy(F.col("w").alias("h")).agg(F.sum(F.expr(more)).alias("more_k"), F.sum(F.col("mean_s") / samples).alias("more_s")).filter("more_k > 0 or more_s <> 0")
        plus = lambda x: (F.col(x) + F.coalesce(F.col(f"more_{x}"), F.lit(0.0))).alias(x)
        tail = tail.join(made, "h", "left").join(k, "h", "left").select("h", "n", plus("made"), plus("k"), plus("s"), "g")
        return fixed.unionByName(self.now.select("u", "w", "c", F.col("side").cast("int").alias("side"), (F.col("mean") / samples).alias("t"))), tail


def _gathered(df: DataFrame, names: tuple[str, ...]) -> list[np.ndarray]:
    got = df.select(*names).toArrow()
    return [got.column(x).to_numpy() for x in names]


def scored(docs: DataFrame, numbered: int = NUMBERED, seed: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities of the whole text).

    A row for each row, repeated ones too, of whole texts however long. Null and empty
    texts are one token, the end. Rows without a doc_id are learned from. With nothing
    to learn from, every word is unknown; an empty table gives an empty result. Words
    are told apart by 64-bit hashes. Other columns, of any name, are ignored."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = docs.mapInArrow(_count, "h long, word string, n long").groupBy("h").agg(F.min("word").alias("word"), F.sum("n").alias("n"))
    counts = written(counts, "words", "zstd")
    done(spark)
    tokens, types = (int(x) for x in counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first())
    speller = sc.broadcast(speller_of(counts, seed))
    end = int(END_HASH)
    is_end = F.col("h") == end
    often = most(counts.filter("n > 0").filter(~is_end), min(numbered, NUMBERED))
    top, n = _gathered(counts.filter(often & ~is_end), ("h", "n"))
    texts = counts.filter(f"h = {end}").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    head = Head(np.append(top.view(U), [END_HASH, BEGIN_HASH]), np.append(n, [texts, texts]).astype(np.int64))
    size = len(head.hash)
    numbers = sc.broadcast(head)
    begin = int(head.number(np.array([BEGIN_HASH]))[0])
    buckets = max(1, -(-tokens // BUCKET))
    tasks = max(1, buckets // 16)
    sent = written(docs.mapInArrow(_sender(numbers, tokens, types), SENT_SQL), "sent", "zstd")
    chains = sent.filter(F.col("kind") == CHAIN).select("base", "n", "raw")
    asked = chains.mapInArrow(_ask(begin, buckets, True), "bucket long, base long, raw binary").select("bucket", "raw")
    table = written(asked.repartition(max(1, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(_tally(size), COUNTED_SQL), "pairs", "zstd")
    del asked
    done(spark)
    alone = _totals(table.filter(F.col("kind") == ALONE).select("id", F.col("pairs").alias("raw")), size)
    numbers.destroy()
    # Pairs with a word that isn't numbered: their customers, at one table to begin with.
    plain = sent.filter(F.col("kind") == PLAIN).select("row", "base", "u", "w", "f", F.col("n").alias("side"), "held_out")
    rare = written(plain.groupBy("u", "w").agg(F.sum(F.when(F.col("held_out"), 0).otherwise(F.col("f"))).alias("c"), F.min("side").alias("side")), "rare", "zstd")
    met = rare.filter("c > 0")
    made = met.groupBy(F.col("u").alias("h")).agg(F.count("*").alias("made"))
    k = met.groupBy(F.col("w").alias("h")).agg(F.count("*").alias("k"))
    zero = F.lit(0.0)
    words_ = counts.join(made, "h", "left").join(k, "h", "left").select("h", "word", "n", F.coalesce(F.col("made").cast("double"), zero).alias("made"), F.coalesce(F.col("k").cast("double"), zero).alias("k"))
    begun = float(met.filter(F.col("u") == int(BEGIN_HASH)).count())
    spelled = written(words_.mapInArrow(_spell(speller, types, seed), "h long, n long, made double, k double, s double, g double"), "spelled", "zstd")
    del words_, made, k
    speller.destroy()
    done(spark, counts)
    of_head = spelled.filter(often | is_end)
    h, rest_made, rest_k, g = _gathered(of_head, ("h", "made", "k", "g"))
    spell, fixed = np.zeros(size), alone  # tables that sampling doesn't move
    at = head.number(h.view(U))
    spell[at] = g
    fixed[0][at] += rest_made
    fixed[1][at] += rest_k
    fixed[0][begin] += begun
    del h, rest_made, rest_k, g, at, alone
    tail = spelled.filter(~often & ~is_end)
    tail_k, tail_s = (float(x or 0.0) for x in tail.agg(F.sum("k"), F.sum("s")).first())
    # Sweeps: the corpus restaurant, then all contexts' restaurants.
    rng = np.random.default_rng(seed)
    d, theta = WORD
    rest = Rest(rare, tail)
    of_context, of_word = _summed(table, size, "t", tasks)
    s_now = np.minimum(1.0, of_word + fixed[1])
    s_sum, samples = np.zeros(size), 0
    table_now = table
    for sweep in range(SWEEPS):
        head.made, customers = of_context + fixed[0] + rest.made, of_word + fixed[1] + rest.k
        del of_context, of_word
        some = customers > 0
        all_s = s_now.sum() + tail_s + rest.all_s
        for i in range(0, size, SLICE):
            on = i + np.flatnonzero(some[i : i + SLICE])
            s_now[on] = seat(rng, np.maximum(1.0, customers[on]), theta + d * np.maximum(0.0, all_s - s_now[on]), spell[on], d)
        s_now[~some] = 0.0
        corpus = float(s_now.sum() + tail_s + rest.all_s), float(customers.sum() + tail_k + rest.all_k)
        head.p = predictive(customers, s_now, *corpus, spell, WORD)
        del customers, some
        shared = sc.broadcast(head)
        seated = written(table_now.filter(F.col("kind") == SEATED).mapInArrow(_sweep(shared, seed + sweep, sweep >= BURN), COUNTED_SQL), "seated", "zstd")
        rest.sweep(shared, head, corpus, (seed + sweep, 1), sweep >= BURN)
        shared.destroy()
        done(spark, table_now)
        table_now = seated
        if sweep >= BURN:
            samples += 1
            s_sum += s_now
        if sweep + 1 < SWEEPS:
            of_context, of_word = _summed(table_now, size, "t", tasks)
    of_context, of_word = (x / samples for x in _summed(table_now, size, "mean", tasks))
    rare_mean, tail = rest.averaged(rare, tail, head, samples)
    head.made, head.k = of_context + fixed[0] + rest.made, of_word + fixed[1] + rest.k
    s_mean = np.minimum(s_sum / samples, head.k)
    all_s, all_k = float(s_mean.sum() + tail_s + rest.all_s), float(head.k.sum() + tail_k + rest.all_k)
    head.p = predictive(head.k, s_mean, all_s, all_k, spell, WORD)
    head.k = None  # not read by tasks
    final = sc.broadcast(head)
    table = table_now
    del of_context, of_word, fixed, spell, s_now, s_sum, s_mean
    part = _scores(sent, table, rare_mean, plain, tail, final, samples, (all_s, all_k), (tokens, types), (begin, buckets), [rare, spelled, *rest.tables])
    return part.withColumn("train_tokens", F.lit(tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _scores(sent: DataFrame, table: DataFrame, rare: DataFrame, plain: DataFrame, tail: DataFrame, final, samples: int, corpus: tuple[float, float], seen: tuple[int, int], deal: tuple[int, int], finished: list[DataFrame]) -> DataFrame:
    """Each text's sums over its packed pairs, its other pairs, and its words."""
    tokens, types = seen
    d, theta = WORD
    all_s, all_k = corpus
    # Words that aren't numbered: their probability in the corpus, and what they are as contexts.
    p = (F.greatest(F.lit(0.0), F.col("k") - d * F.col("s")) + F.lit(theta + d * all_s) * F.col("g")) / F.lit(theta + all_k)
    base = F.log10((F.col("n") + 0.1) / F.lit(tokens + 0.1 * (types + 1)))
    stats = written(tail.select("h", "n", "made", p.alias("p"), base.alias("base")), "tail", "zstd")
    first, second = F.col("side") % 2 == 1, F.col("side") >= 2
    none = F.lit(None)
    left = stats.select(F.col("h").alias("u"), F.col("n").alias("own_c"), "made")
    valued = rare.filter(~first).join(left, "u").unionByName(rare.filter(first).withColumn("own_c", none.cast("long")).withColumn("made", none.cast("double")))
    right = stats.select(F.col("h").alias("w"), "p", "base", (F.col("n") > 0).cast("long").alias("met"))
    valued = valued.filter(~second).join(right, "w").unionByName(valued.filter(second).select("*", none.cast("double").alias("p"), F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("met")))

    def value(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = final.value
        schema = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("y", pa.float64()), ("base", pa.float64()), ("met", pa.int64())])
        for b in batches:
            u, w = (head.number(b.column(x).to_numpy().view(U)) for x in ("u", "w"))
            own_c, made, p = (b.column(x).cast(pa.float64()).fill_null(0.0).to_numpy() for x in ("own_c", "made", "p"))
            c, t = b.column("c").to_numpy(), b.column("t").to_numpy()
            y = predictive(c, t, np.where(u >= 0, head.made[u], made), np.where(u >= 0, head.n[u], own_c), np.where(w >= 0, head.p[w], p))
            yield batch(schema, b.column("u"), b.column("w"), np.log10(np.maximum(y, 1e-300)), b.column("base"), b.column("met"))

    valued = valued.select("u", "w", "c", "t", "own_c", "made", "p", "base", "met").mapInArrow(value, "u long, w long, y double, base double, met long")
    others = plain.select("base", "row", "u", "w", "f").withColumnRenamed("base", "at").join(valued, ["u", "w"]).groupBy("at", "row").agg(F.sum(F.col("f") * F.col("y")).alias("y"), F.sum(F.col("f") * F.col("base")).alias("x"), F.sum(F.col("f") * F.col("met")).alias("known"))
    others = written(others, "others", "zstd")
    del valued
    done(plain.sparkSession, stats, *finished)

    def answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket, its seated pairs before what chunks ask: whether each
        pair is among them, and the logarithms of those that are."""
        head: Head = final.value
        here, pairs, log = None, np.zeros(0, U), np.zeros(0, np.float32)
        for b in batches:
            out = []
            for bucket, at, raw, c, mean in zip(*(b.column(x).to_pylist() for x in ("bucket", "base", "raw", "c", "mean")), strict=True):
                if c is not None:
                    here, pairs = bucket, unplaned(raw, 5)
                    u, w = _sides(pairs)
                    c, t = unplaned(c, 5).astype(float), np.frombuffer(mean, "<f4") / samples
                    log = np.log10(np.maximum(1e-300, predictive(c, t, head.made[u], head.n[u], head.p[w]))).astype("<f4")
                    continue
                if bucket != here:
                    here, pairs, log = bucket, np.zeros(0, U), np.zeros(0, np.float32)
                pair = unplaned(raw, 5)
                i = np.searchsorted(pairs, pair).clip(max=max(0, len(pairs) - 1))
                met = pairs[i] == pair if len(pairs) else np.zeros(len(pair), bool)
                out.append((bucket, at, np.packbits(met).tobytes() + log[i[met]].tobytes()))
            if out:
                yield batch(ASKED, *map(list, zip(*out, strict=True)))

    zero = F.lit(0).cast("long")
    begin, buckets = deal
    rows = table.filter(F.col("kind") == SEATED).select(F.col("id").alias("bucket"), zero.alias("ord"), zero.alias("base"), F.col("pairs").alias("raw"), "c", "mean")
    chains = sent.filter(F.col("kind") == CHAIN).select("base", "n", "raw")
    asked = chains.mapInArrow(_ask(begin, buckets, False), "bucket long, base long, raw binary").select("bucket", F.lit(1).cast("long").alias("ord"), "base", "raw", none.cast("binary").alias("c"), none.cast("binary").alias("mean"))
    answers = rows.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "ord").mapInArrow(answered, "bucket long, base long, raw binary")
    sums = answers.select("base", zero.alias("ord"), "raw", F.col("bucket").alias("row"), *(none.cast(k).alias(c) for c, k in (("doc_id", "long"), ("held_out", "boolean"), ("n", "long"), ("known", "long"), ("x", "double"), ("y", "double"))))
    chains = chains.select("base", F.lit(3).cast("long").alias("ord"), "raw", zero.alias("row"), none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"), "n", zero.alias("known"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    # Answers, the sums of other pairs, and the texts' own rows meet by the chunk they came from.
    texts = sent.filter(F.col("kind") == DOC).select("base", F.lit(1).cast("long").alias("ord"), none.cast("binary").alias("raw"), "row", "doc_id", "held_out", "n", "known", "x", F.lit(0.0).alias("y"))
    rest = others.select(F.col("at").alias("base"), F.lit(2).cast("long").alias("ord"), none.cast("binary").alias("raw"), "row", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"), zero.alias("n"), "known", "x", "y")

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = final.value
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        for g in groups(batches, "base"):
            order = g.column("ord").to_numpy()
            own = g.filter(pa.array(order == 1)).sort_by("row")
            size, at = len(own), int(g.column("base")[0].as_py())
            known, x = own.column("known").to_numpy().copy(), own.column("x").to_numpy().copy()
            (chain,) = g.filter(pa.array(order == 3)).column("raw")
            chain = Chain(chain.as_py(), size, begin, buckets)
            log = np.zeros(len(chain.pair))
            place = dict(chain.dealt())
            answers = g.filter(pa.array(order == 0))
            for bucket, raw in zip(answers.column("row").to_pylist(), answers.column("raw"), strict=True):
                i, raw = place[bucket], raw.as_py()
                n = -(-len(i) // 8)
                met = np.unpackbits(np.frombuffer(raw, np.uint8, n), count=len(i)).astype(bool)
                log[i[met]] = np.frombuffer(raw, "<f4", -1, n)
                u, w = _sides(chain.pair[i[~met]])  # the only occurrence is here
                c = chain.c[i[~met]]
                log[i[~met]] = np.log10(np.maximum(1e-300, predictive(c, c, head.made[u], head.n[u], head.p[w])))
            y = np.bincount(chain.doc, log[np.searchsorted(chain.pair, chain.each)], minlength=size).astype(float)  # of nothing it counts in integers
            more = g.filter(pa.array(order == 2))
            if len(more):
                i = more.column("row").to_numpy() - at
                y[i] += more.column("y").to_numpy()
                x[i] += more.column("x").to_numpy()
                known[i] += more.column("known").to_numpy()
            yield batch(schema, own.column("doc_id").combine_chunks(), own.column("held_out").combine_chunks(), own.column("n").to_numpy(), known, x, y)

    every = sums.unionByName(texts).unionByName(rest).unionByName(chains).repartition("base").sortWithinPartitions("base")
    return every.mapInArrow(joined, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """Per row of scored(): perplexity of a token."""
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
