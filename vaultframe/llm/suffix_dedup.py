"""Exact removal of repeated byte strings with suffix arrays.

Every string of `length` bytes has an anchor: of the grams inside it, the one of the
least hash, leftmost among equals, so equal strings have equal anchors at equal places.
Strings can repeat only where their anchor's gram does, which a count of grams decides
for the whole corpus. Around each repeated anchor lies a segment, the bytes of all the
strings it anchors; segments of one gram meet in one shard. There, a suffix array made
by Larsson-Sadakane refinement (ranks of doubled depth, sorting only the groups not yet
told apart) and Kasai's common prefixes tell which strings occur twice. A gram with more
segments than a shard takes is spread over several tasks' shards. Each of these deals
its sorted strings, as 128-bit fingerprints, by ranges; a range's strings of all shards
are merged by binary search, and every shard hears which of its own another one has too.
Identical segments travel at most twice from each partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import GOLD, U, batch, chunks, done, groups, hashes, mix64, packs, powers, symbols, written
from vaultframe.llm.components import hot_join

LENGTH, GRAM = 200, 40
#: Bytes of segments in one suffix array, and of a gram's segments in one task; ranges
#: of strings for each task of a gram that has several.
SHARD_BYTES, TASK_BYTES, RANGES = 3 << 19, 24 << 20, 8
#: Grams with several tasks that are broadcast; more are joined by a shuffle.
MAX_HOT = 1_000_000
_BYTES, _OTHER = symbols(np.arange(256, dtype=np.uint8), 11), symbols(np.arange(256, dtype=np.uint8), 13)


def rolling(data: np.ndarray, k: int, symbol: np.ndarray) -> np.ndarray:
    """Hash of every data[i:i + k]."""
    n = len(data)
    if n < k:
        return np.zeros(0, U)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U)
        np.cumsum(symbol[data] * up[:n], out=total[1:])
        x = total[k:] - total[:-k]
        x *= down[: n - k + 1]
    return mix64(x)


def anchors(t, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's texts: the gram hash of each anchor, its place in the chunk's bytes,
    and the first and last start of the strings that it anchors."""
    none = np.zeros(0, np.int64)
    data = t.data
    if len(data) < length:
        return np.zeros(0, U), none, none, none
    h = rolling(data, gram, _BYTES)
    key = (h >> U(32) << U(32)) | np.arange(len(h), dtype=U)
    width, span = length - gram + 1, 1
    least = key
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(key) - width + 1], least[width - span :][: len(key) - width + 1])
    starts = np.arange(len(least))
    room = np.repeat(t.offs[1:], np.diff(t.offs))[: len(least)] - starts >= length
    starts, at = starts[room], (least[room] & U(0xFFFFFFFF)).astype(np.int64)
    if not len(starts):
        return np.zeros(0, U), none, none, none
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(new[1:], len(starts)) - 1
    return h[at[new]], at[new], starts[new], starts[last]


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Larsson-Sadakane refinement up to at least depth bytes: suffixes in order, their
    ranks, and the eight bytes at each place as an integer."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(n, U)
    for j in range(8):
        words |= padded[j : j + n].astype(U) << U(56 - 8 * j)
    order = np.argsort(words)
    new = np.concatenate([[True], words[order[1:]] != words[order[:-1]]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + depth + 256, np.int64)
    rank[order] = first + 1
    live = np.flatnonzero(~(new & np.append(new[1:], True)))  # slots of groups not told apart
    h = 8
    while h < depth and len(live):
        at = order[live]
        low = rank[at]
        key = (low << 32) | rank[at + h]
        o = np.argsort(key)
        at, low, key = at[o], low[o], key[o]
        order[live] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        old = np.concatenate([[True], low[1:] != low[:-1]])
        i = np.arange(len(at))
        rank[at] = low + np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(old, i, 0))
        live = live[~(new & np.append(new[1:], True))]
        h *= 2
    # Suffixes equal to that depth keep one rank; here each gets a place.
    place = np.zeros(n, np.int64)
    place[order] = np.arange(n)
    return order, place, words


def kasai(order: np.ndarray, place: np.ndarray, words: np.ndarray, first: np.ndarray, last: np.ndarray, cap: int) -> np.ndarray:
    """Bytes in common with the suffix before in order, up to cap, at the places
    first..last of each run: a suffix shares at least one less than the one that starts
    a byte earlier. Runs advance together."""
    n = len(order)
    out = np.zeros(n, np.int16)
    same = np.zeros(len(first), np.int64)
    padded = np.concatenate([words, np.zeros(cap + 16, U)])
    runs = np.arange(len(first))
    for step in range(int((last - first).max(initial=-1)) + 1):
        runs = runs[first[runs] + step <= last[runs]]
        i = first[runs] + step
        p = place[i]
        j = order[np.maximum(p - 1, 0)]
        s = np.maximum(same[runs] - 1, 0)
        s[p == 0] = 0
        todo = np.flatnonzero((p > 0) & (s < cap))
        while len(todo):
            x = padded[i[todo] + s[todo]] ^ padded[j[todo] + s[todo]]
            equal = x == 0
            part = todo[~equal]
            s[part] += np.searchsorted(_LEAD, ~x[~equal], "right") if len(part) else 0
            s[todo[equal]] += 8
            todo = todo[equal]
            todo = todo[s[todo] < cap]
        s = np.minimum(s, cap)
        same[runs] = s
        out[i] = s
    return out


#: ~x of two words that share their first k bytes is at least the k-th of these.
_LEAD = np.array([((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(1, 8)], U)


def repeated(segments: list[bytes], starts: np.ndarray, length: int = LENGTH, limit: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each of some distinct segments, which of its first starts[i] places begin a
    string of length bytes that any of the others, or itself elsewhere, holds too."""
    sizes = np.array([len(s) for s in segments])
    shard = (np.cumsum(sizes) - sizes) // limit
    flags: list[np.ndarray] = []
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        data = np.frombuffer(b"".join(segments[lo:hi]), np.uint8)
        first = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
        order, place, words = suffix_array(data, length)
        common = kasai(order, place, words, first, first + starts[lo:hi] - 1, length)
        begins = np.zeros(len(data) + 1, np.int32)
        np.add.at(begins, first, 1)
        np.add.at(begins, first + starts[lo:hi], -1)
        valid = np.cumsum(begins[:-1]) > 0
        ranked = order[valid[order]]
        alike = _alike(ranked, common, words, length)
        found = np.zeros(len(data), bool)
        found[ranked[1:][alike]] = True
        found[ranked[:-1][alike]] = True
        flags.append(found)
        if len(cuts) > 2:
            at = np.flatnonzero(valid)
            a, b = rolling(data, length, _BYTES)[at], rolling(data, length, _OTHER)[at]
            by = np.argsort(a)
            runs.append((a[by], b[by], at[by]))
    for x, (a, b, at) in enumerate(runs):  # each shard's strings looked up in the others'
        for y, (c, d, other) in enumerate(runs):
            if x != y:
                i = np.searchsorted(c, a).clip(max=max(len(c) - 1, 0))
                hit = (c[i] == a) & (d[i] == b) if len(c) else np.zeros(len(a), bool)
                flags[x][at[hit]] = True
    out = []
    for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        first = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
        out += [flags[k][f : f + n] for f, n in zip(first.tolist(), starts[lo:hi].tolist(), strict=True)]
    return out


def _alike(ranked: np.ndarray, common: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether each of some suffixes, in order, shares length bytes with the one before
    it. Only those that share them with whatever comes before can; and as suffixes equal
    to the array's depth stand in any order, the bytes themselves decide."""
    out = common[ranked[1:]] >= length
    i = np.flatnonzero(out)
    for j in [*range(0, length - 7, 8), length - 8]:
        i = i[words[ranked[i + 1] + j] == words[ranked[i] + j]]
    out[:] = False
    out[i] = True
    return out


SEGMENTS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("starts", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("h", pa.int64()), ("segment", pa.binary())])
FOUND = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("runs", pa.list_(pa.int32()))])


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's anchors by gram, a row for each gram with all its places: a gram that
    a text repeats thousands of times is one row."""
    schema = pa.schema([("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("places", pa.list_(pa.int32()))])
    for b in batches:
        k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
        for t in chunks(b.column("text")):
            h, at, _, _ = anchors(t)
            doc = np.searchsorted(t.offs, at, "right") - 1
            order = np.lexsort((h, doc))
            h, at, doc = h[order], at[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(np.append(first, len(h)).astype(np.int32), pa.array((at - t.offs[doc]).astype(np.int32)))
            yield batch(schema, h[first].view(np.int64), k1[t.lo + doc[first]], k2[t.lo + doc[first]], lists)


def _segment_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments around the repeated anchors of each text. Rows come sorted by text; of
    equal ones two suffice. A segment's bytes go along the first two times."""
    before, copies = None, 0
    sent: dict[tuple[int, int], int] = {}
    for b in batches:
        k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
        places = b.column("places")
        offs = places.offsets.to_numpy()
        flat = places.values.to_numpy()
        for t in chunks(b.column("text")):
            use = np.zeros(len(t), bool)
            for i in range(len(t)):
                key = (k1[t.lo + i], k2[t.lo + i])
                copies = copies + 1 if key == before else 1
                before = key
                use[i] = copies <= 2
            h, at, lo, hi = anchors(t)
            doc = np.searchsorted(t.offs, at, "right") - 1
            wanted = np.concatenate([np.unique(flat[offs[t.lo + i] : offs[t.lo + i + 1]]).astype(np.int64) + t.offs[i] for i in range(len(t))])
            keep = np.flatnonzero(use[doc] & np.isin(at, wanted)) if len(at) else np.zeros(0, np.int64)
            if not len(keep):
                continue
            h, at, lo, hi, doc = h[keep], at[keep], lo[keep], hi[keep], doc[keep]
            n = hi - lo + 1
            salt = mix64((at - lo).astype(U) * GOLD + n.astype(U))
            f1 = (hashes(t.data, lo, hi + LENGTH, _BYTES) ^ salt).view(np.int64)
            f2 = (hashes(t.data, lo, hi + LENGTH, _OTHER) + salt).view(np.int64)
            raw = t.data.tobytes()
            rows = []
            for f, g, a, z in zip(f1.tolist(), f2.tolist(), lo.tolist(), hi.tolist(), strict=True):
                times = sent.get((f, g), 0)
                if times < 2:
                    sent[f, g] = times + 1
                rows.append(raw[a : z + LENGTH] if times < 2 else None)
            if len(sent) > 100_000:
                sent = {}
            yield batch(SEGMENTS, k1[t.lo + doc], k2[t.lo + doc], (lo - t.offs[doc]).astype(np.int32), n.astype(np.int32), f1, f2, h.view(np.int64), rows)


def _runs(flags: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (task, h, f1, f2): per distinct segment, the runs of places whose
    strings repeat among the task's segments of its gram; those without any are left out."""
    for g in packs(batches, "task", SHARD_BYTES):
        h, f1, f2 = (g.column(c).to_numpy() for c in ("h", "f1", "f2"))
        starts = g.column("starts").to_numpy()
        new = np.concatenate([[True], (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1]) | (h[1:] != h[:-1])])
        first = np.flatnonzero(new)
        twice = np.diff(np.append(first, len(f1))) > 1
        hh = h[first]
        group = np.cumsum(np.concatenate([[True], hh[1:] != hh[:-1]])) - 1
        several = np.bincount(group)[group] > 1
        out: list[list[int]] = [[0, int(n)] if two else [] for n, two in zip(starts[first].tolist(), twice.tolist(), strict=True)]
        todo = np.flatnonzero(several)
        if len(todo):
            column = g.column("segment").take(pa.array(first[todo])).to_pylist()
            flags = repeated(column, starts[first][todo].astype(np.int64))
            for i, f in zip(todo.tolist(), flags, strict=True):
                if not twice[i] and f.any():
                    out[i] = _runs(f)
        # A segment alone may repeat itself only under one anchor at two places, which is two segments.
        some = [i for i, x in enumerate(out) if x]
        if some:
            yield batch(FOUND, f1[first][some], f2[first][some], [out[i] for i in some])


STRINGS = pa.schema([("h", pa.int64()), ("slot", pa.int64()), ("part", pa.int32()), ("raw", pa.binary())])
STRINGS_SQL = "h long, slot long, part int, raw binary"


def _fingerprints(segments: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of the strings at the first places of each segment, and the segments'
    offsets among them."""
    a, b = [], []
    for x, n in zip(segments, starts.tolist(), strict=True):
        data = np.frombuffer(x, np.uint8)
        a.append(rolling(data, LENGTH, _BYTES)[:n])
        b.append(rolling(data, LENGTH, _OTHER)[:n])
    return np.concatenate(a), np.concatenate(b), np.concatenate([[0], np.cumsum(starts)])


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), [("a", U), ("b", U)])
    out["a"], out["b"] = a, b
    return out


def _offer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct strings of each task's share of a hot gram, by range."""
    for g in packs(batches, "task", SHARD_BYTES):
        keys, slots, parts = (g.column(c).to_numpy() for c in ("h", "task", "parts"))
        for task in np.unique(slots):
            rows = np.flatnonzero(slots == task)
            h, salt, n = int(keys[rows[0]]), int(g.column("salt")[int(rows[0])].as_py()), int(parts[rows[0]])
            segments = [g.column("segment")[int(i)].as_py() for i in rows]
            a, b, _ = _fingerprints(segments, g.column("starts").to_numpy()[rows])
            x = np.unique(_pairs(a, b))
            r = ((x["a"] >> U(32)) * U(RANGES * n) >> U(32)).astype(np.int64)
            for k in np.unique(r).tolist():
                yield batch(STRINGS, [h], [k], [salt], [x[r == k].tobytes()])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range: each share's strings that another share has too. A share's
    strings are looked up, by binary search, among those of the shares before it."""
    kind = np.dtype([("a", U), ("b", U)])
    for g in groups(batches, "range"):
        runs: dict[tuple[int, int, int], np.ndarray] = {}
        for h, slot, part, raw in zip(*(g.column(c).to_pylist() for c in STRINGS.names), strict=True):
            own = np.frombuffer(raw, kind)
            key = (h, slot, part)
            runs[key] = np.union1d(runs[key], own) if key in runs else own  # a share may send more than once
        by: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for (h, slot, part), x in sorted(runs.items(), key=lambda r: r[0]):
            by.setdefault((h, slot), []).append((part, x))
        for (h, slot), own in by.items():
            every = np.sort(np.concatenate([x for _, x in own]))
            both = every[1:][every[1:] == every[:-1]]
            for part, x in own:
                i = np.searchsorted(both, x).clip(max=max(0, len(both) - 1))
                hit = x[both[i] == x] if len(both) else x[:0]
                if len(hit):
                    yield batch(STRINGS, [h], [slot], [part], [hit.tobytes()])


def _heard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (task, ord): what a share heard, then its segments; the runs of
    places whose strings are among it."""
    kind = np.dtype([("a", U), ("b", U)])
    task, heard, known = None, [], np.zeros(0, kind)
    for b in batches:
        out = []
        for t, h_raw, f1, f2, n, segment in zip(*(b.column(c).to_pylist() for c in ("task", "raw", "f1", "f2", "starts", "segment")), strict=True):
            if t != task:
                task, heard, known = t, [], np.zeros(0, kind)
            if h_raw is not None:
                heard.append(np.frombuffer(h_raw, kind))
                continue
            if heard:
                known, heard = np.unique(np.concatenate([known, *heard])), []
            if not len(known):
                continue
            a, c, _ = _fingerprints([segment], np.array([n]))
            x = _pairs(a, c)
            i = np.searchsorted(known, x).clip(max=len(known) - 1)
            hit = known[i] == x
            if hit.any():
                out.append((f1, f2, _runs(hit)))
        if out:
            yield batch(FOUND, *map(list, zip(*out, strict=True)))


def _across(shares: DataFrame) -> DataFrame:
    """(f1, f2, runs) of strings that several shares of a gram have. shares: distinct
    segments of grams that have several tasks."""
    columns = ("h", "task", "salt", "parts", "f1", "f2", "starts", "segment")
    shares = shares.select(*columns)
    offered = shares.repartition("task").sortWithinPartitions("task").mapInArrow(_offer, STRINGS_SQL)
    ranges = offered.withColumn("range", F.xxhash64("h", "slot")).repartition("range").sortWithinPartitions("range")
    merged = written(ranges.mapInArrow(_merge, STRINGS_SQL), "merged")
    none = F.lit(None)
    told = merged.select(_task(F.col("h"), F.col("part")).alias("task"), F.lit(0).alias("ord"), "raw", none.cast("long").alias("f1"), none.cast("long").alias("f2"), none.cast("int").alias("starts"), none.cast("binary").alias("segment"))
    own = shares.select("task", F.lit(1).alias("ord"), none.cast("binary").alias("raw"), "f1", "f2", "starts", "segment")
    return told.unionByName(own).repartition("task").sortWithinPartitions("task", "ord").mapInArrow(_heard, "f1 long, f2 long, runs array<int>")


def _task(h, salt):
    return F.xxhash64(h, salt.cast("int"))


def _twice(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts that a partition has many times, two: more tell nothing."""
    seen: dict[tuple[int, int], int] = {}
    for b in batches:
        keep = []
        for key in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True):
            n = seen[key] = seen.get(key, 0) + 1
            keep.append(n <= 2)
        if len(seen) > 200_000:
            seen = {}
        yield b.filter(pa.array(keep))


def repeats(docs: DataFrame, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """docs with the keys k1, k2 of each text, and per key the places (start, end) where
    strings that begin there repeat."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("k1", F.xxhash64(raw)).withColumn("k2", F.xxhash64(F.lit(1), F.lit(7), raw))
    texts = keyed.filter(F.octet_length("text") >= LENGTH).select("k1", "k2", "text")
    found = written(texts.mapInArrow(_anchor_rows, "h long, k1 long, k2 long, places array<int>"), "anchors")
    again = found.groupBy("h").agg(F.sum(F.size("places")).alias("all"), F.count("*").alias("n")).filter("all > 1").select("h", "n")
    places = hot_join(found, again, ["h"], found.count()).groupBy("k1", "k2").agg(F.flatten(F.collect_set("places")).alias("places"))
    places = written(places, "places")
    done(spark)
    kind = "k1 long, k2 long, text string"
    joined = texts.mapInArrow(_twice, kind).join(places, ["k1", "k2"]).sortWithinPartitions("k1", "k2")
    segments = written(joined.mapInArrow(_segment_rows, "k1 long, k2 long, first int, starts int, f1 long, f2 long, h long, segment binary"), "segments")
    done(spark)
    sent = segments.filter("segment is not null").select("h", "f1", "f2", "starts", "segment")
    hot = written(sent.groupBy("h").agg(F.sum(F.octet_length("segment")).alias("bytes")).filter(F.col("bytes") > task_bytes).select("h", F.ceil(F.col("bytes") / task_bytes).cast("int").alias("parts")), "hot")
    many = hot.count()
    parted = sent.join(F.broadcast(hot) if many <= MAX_HOT else hot, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("salt", F.pmod("f1", F.col("parts")).cast("int")).withColumn("task", _task(F.col("h"), F.col("salt")))
    dealt = parted.select("h", "f1", "f2", "starts", "segment", "task").repartition("task").sortWithinPartitions("task", "h", "f1", "f2")
    runs = dealt.mapInArrow(_shards, "f1 long, f2 long, runs array<int>")
    if many:
        runs = runs.unionByName(_across(parted.filter("parts > 1").dropDuplicates(["task", "f1", "f2"])))
    runs = written(runs, "runs")
    done(spark)
    members = segments.select("k1", "k2", "first", "f1", "f2").join(runs, ["f1", "f2"])
    spans = members.select("k1", "k2", F.transform("runs", lambda x: x + F.col("first")).alias("runs")).groupBy("k1", "k2").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    return keyed, spans


def _gone(runs: list[int] | None, n: int) -> np.ndarray:
    """Starts and ends, in turn, of the maximal removed runs of bytes."""
    if not runs:
        return np.zeros(0, np.int64)
    r = np.array(runs, np.int64).reshape(-1, 2)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, r[:, 0], 1)
    np.add.at(edge, r[:, 1] - 1 + LENGTH, -1)
    return np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])))


REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in chunks(b.column("text")):
            runs = b.column("runs").slice(t.lo, len(t)).to_pylist()
            rows = []
            for i in range(len(t)):
                raw = t.text(i)
                cut = _gone(runs[i], len(raw)).tolist()
                kept = b"".join(raw[x:y] for x, y in zip([0, *cut[1::2]], [*cut[::2], len(raw)], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(cut) // 2, hashlib.sha256(kept).hexdigest()))
            yield batch(REMOVED, b.column("doc_id").slice(t.lo, len(t)), *map(list, zip(*rows, strict=True)))


def removed(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A row for each row, of whole texts however long; equal rows are copies of each other,
    and of tied copies none is spared. Null and empty texts, and those shorter than the
    length, lose nothing; an empty table gives an empty result. Other columns, of any
    name, are ignored."""
    keyed, spans = repeats(docs.select("doc_id", "text"), task_bytes)
    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "runs").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the repeated bytes cut from text; a character that a cut
    runs through goes as a whole, and n_chars, where there is such a column, counts what
    is left. Null texts stay null, empty ones empty; rows of null or shared ids and
    repeated rows are each cut by their own text, however long; an empty table stays
    empty. Other columns, of any name, are handed on as they are."""
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    keyed, spans = repeats(docs.select(F.struct(*others).alias("_rest"), "text"))

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t in chunks(b.column("text")):
                runs = b.column("runs").slice(t.lo, len(t)).to_pylist()
                for i in range(len(t)):
                    raw = t.text(i)
                    cut = _gone(runs[i], len(raw)).tolist()
                    kept = b"".join(raw[x:y] for x, y in zip([0, *cut[1::2]], [*cut[::2], len(raw)], strict=True))
                    texts.append(kept.decode(errors="ignore"))
            null = b.column("text").is_null().to_pylist()
            rest = dict(zip(others, b.column("_rest").flatten(), strict=True))
            out = []
            for c in columns:
                if c == "text":
                    out.append(pa.array([None if z else x for x, z in zip(texts, null, strict=True)], pa.string()))
                elif c == "n_chars":
                    out.append(pa.array([len(x) for x in texts], pa.int64()))
                else:
                    out.append(rest[c])
            yield pa.RecordBatch.from_arrays(out, names=columns)

    kind = ", ".join(f"`{f.name}` {'long' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in docs.schema.fields)
    return keyed.join(spans, ["k1", "k2"], "left").select("_rest", "text", "runs").mapInArrow(step, kind)
