"""Near-duplicate grouping by SuperMinHash.

Every element of a document's shingle set ranks the signature's slots by a permutation
of its own (a seeded Fisher-Yates shuffle, made step by step); step j offers the slot
that is j-th in that permutation the value j + u. A document stops as soon as every
slot holds less than j + 1, which long documents reach after two or three steps. Slots
agree with the Jaccard similarity as probability, with less variance than independent
hashes give.

Bands of six slots name candidate groups. Documents of one shingle set are one class;
classes that share bands form coarse clusters, whose full shingle sets meet in one task
and are compared exactly: one class after another, against all classes of the cluster
that it isn't joined with yet, until all but the classes of the largest component have
been compared. Clusters beyond max_elements are first dealt by size, as sets can only be
linked with sets of nearly their own size, and what is still too large as blocks of two
slices each, joined afterwards, so that no task holds more than two slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import GOLD, WHITE, U, Words, batch, chunks, groups, mix64, symbols, tidy, windows, written
from vaultframe.llm.components import components, hot_join

#: Slots of a signature, and slots of a band. A pair of similarity 0.85 shares none of
#: the 32 bands with probability (1 - 0.85 ** 6) ** 32 = 3e-7, one of 0.8 with 6e-5.
#: Pairs of similarity 0.3, of which large corpora are full, share one with 0.02.
SLOTS, ROWS = 192, 6
SHINGLE = 5
#: Shingles of one cluster that one task compares.
MAX_ELEMENTS = 1_000_000


def shingle_sets(t, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and offsets per text.
    Fewer words than width are one shingle, no words none."""
    w = Words(t, ~WHITE, symbols())
    n = np.diff(w.first)
    h = windows(w.hash, width)
    ok = w.doc[width - 1 :] == w.doc[: len(h)] if len(h) else np.zeros(0, bool)
    h, doc = h[ok], w.doc[: len(ok)][ok]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        with np.errstate(over="ignore"):
            x = n[short].astype(U) * GOLD
            for j in range(width - 1):
                has = n[short] > j
                x[has] = mix64(x[has] ^ w.hash[w.first[short][has] + j]) + U(j + 1)
        h, doc = np.concatenate([h, x]), np.concatenate([doc, short.astype(np.int32)])
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(t) < 65536 else doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(t) + 1))


def signatures(h: np.ndarray, offs: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set as step << 32 | rank; sets without elements keep the
    largest value in every slot."""
    docs = len(offs) - 1
    sig = np.full((docs, slots), np.iinfo(np.int64).max, np.int64)
    flat = sig.reshape(-1)
    doc = np.repeat(np.arange(docs), np.diff(offs))
    x = h.copy()
    picks: list[np.ndarray] = []
    for j in range(slots):
        if not len(x):
            break
        with np.errstate(over="ignore"):
            r = mix64(x + U(j + 1) * GOLD)
        rank, rest = (r >> U(32)).astype(np.int64), (r & U(0xFFFFFFFF))
        pick = j + ((rest * U(slots - j)) >> U(32)).astype(np.int16)
        slot = pick.copy()
        for i in range(j - 1, -1, -1):
            slot[picks[i] == slot] = i
        np.minimum.at(flat, doc * slots + slot, (j << 32) | rank)
        picks.append(pick)
        open_ = (sig >> 32).max(axis=1) > j  # a slot may still get less
        stay = open_[doc]
        if not stay.all():
            x, doc, picks = x[stay], doc[stay], [p[stay] for p in picks]
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    docs, slots = sig.shape
    parts = sig.reshape(docs, slots // rows, rows).astype(U)
    with np.errstate(over="ignore"):
        out = np.arange(slots // rows, dtype=U)[None, :] * GOLD
        for j in range(rows):
            out = mix64(out ^ (parts[:, :, j] + U(j) * GOLD))
    return out.view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("node", pa.int64()), ("block", pa.int64()), ("shingles", pa.binary())])
JOINED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sums(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set, by which equal sets are known."""
    some, n = offs[:-1].clip(max=len(h)), np.diff(offs)
    return tuple(np.where(n > 0, np.add.reduceat(np.append(mix64(x), U(0)), some), U(0)).view(np.int64) for x in (h, h ^ GOLD))


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id")
        for t in chunks(b.column("text")):
            h, offs = shingle_sets(t)
            of = bands(signatures(h, offs))
            lists = pa.ListArray.from_arrays(np.arange(0, (len(t) + 1) * of.shape[1], of.shape[1], dtype=np.int32), pa.array(of.reshape(-1)))
            yield batch(SIGNED, ids.slice(t.lo, len(t)), np.diff(offs).astype(np.int64), *_sums(h, offs), lists)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts that are those of their row's class: of several rows under one
    doc_id others may come along."""
    for b in batches:
        for t in chunks(b.column("text")):
            h, offs = shingle_sets(t)
            s1, s2 = _sums(h, offs)
            raw, (own1, own2, node, block) = h.tobytes(), (b.column(c).slice(t.lo, len(t)).to_numpy() for c in ("s1", "s2", "node", "block"))
            at = np.flatnonzero((s1 == own1) & (s2 == own2))
            yield batch(SETS, node[at], block[at], [raw[offs[i] * 8 : offs[i + 1] * 8] for i in at.tolist()])


def linked(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of ids under 100 * intersection >= percent *
    union. Exact: only pairs that are already joined stay uncompared."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    ids, sets, sizes = ids[order], [sets[i] for i in order], sizes[order]
    every, element = np.unique(np.concatenate(sets), return_inverse=True)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(every), np.int8)
    common = np.bincount(element, minlength=len(every))
    central = np.add.reduceat(common[element], offs[:-1]) / sizes
    root, done, links = np.arange(n), np.zeros(n, bool), []
    queue = np.argsort(-central, kind="stable")
    while True:
        open_ = queue[~done[queue]]
        names, counts = np.unique(root[open_], return_counts=True)
        if len(names) <= 1:  # whatever two are left are joined with each other
            break
        giant = names[np.argmax(counts)] if counts.max() > 1 else -1
        for x in open_[root[open_] != giant][: 1 if giant < 0 else 16].tolist():
            lo, hi = np.searchsorted(sizes, -(-percent * sizes[x] // 100)), np.searchsorted(sizes, 100 * sizes[x] // percent, "right")
            mark[element[offs[x] : offs[x + 1]]] = 1
            both = np.add.reduceat(mark[element[offs[lo] : offs[hi]]], offs[lo:hi] - offs[lo], dtype=np.int64)
            mark[element[offs[x] : offs[x + 1]]] = 0
            for y in (lo + np.flatnonzero(100 * both >= percent * (sizes[lo:hi] + sizes[x] - both))).tolist():
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    links.append((int(ids[x]), int(ids[y])))
            done[x] = True
    return links


def _compare(percent: int):
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "block"):
            nodes, once = np.unique(g.column("node").to_numpy(), return_index=True)
            raw = g.column("shingles")
            links = linked(nodes, [np.frombuffer(raw[i].as_py(), U) for i in once.tolist()], percent) if len(nodes) > 1 else []
            if links:
                a, b = zip(*links, strict=True)
                yield batch(JOINED, list(a), list(b))

    return step


KEY = ["s1", "s2", "n_shingles"]


def _same_id(whole: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of the classes that rows under one doc_id have."""
    of = F.struct(*KEY)
    shared = whole.groupBy("doc_id").agg(F.min(of).alias("x"), F.max(of).alias("y")).filter("x <> y").select("doc_id")
    nodes = whole.select("doc_id", *KEY).join(shared, "doc_id", "left_semi").distinct().join(classes.select("node", *KEY), KEY).select("doc_id", "node")
    least = nodes.groupBy("doc_id").agg(F.min("node").alias("m"))
    return nodes.join(least, "doc_id").filter("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))


def _blocks(members: DataFrame, percent: int, max_elements: int) -> DataFrame:
    """members (node, cluster, n_shingles, ...) with the block or blocks in which each is
    compared. A cluster of more than max_elements shingles is dealt by size: sets of
    which one is a linked one's partner are at most percent apart, so in bins of that
    width they lie in the same or in neighbouring bins. Bins still too large are dealt
    by hash, as blocks of two slices."""
    large = members.groupBy("cluster").agg(F.sum("n_shingles").alias("elements")).filter(F.col("elements") > max_elements).select("cluster", F.lit(True).alias("large"))
    width = max(math.log(100 / percent) * 1.000001, 1e-6)
    low = F.floor(F.log(F.col("n_shingles").cast("double")) / width)
    bins = F.when(F.coalesce("large", F.lit(False)), F.array(low, low + 1)).otherwise(F.array(F.lit(0).cast("long")))
    dealt = members.join(large, "cluster", "left").withColumn("bin", F.explode(bins)).drop("large")
    full = dealt.groupBy("cluster", "bin").agg(F.sum("n_shingles").alias("elements")).filter(F.col("elements") > max_elements)
    parts = F.coalesce(F.ceil(F.col("elements") / max_elements), F.lit(1)).cast("int")
    dealt = dealt.join(full, ["cluster", "bin"], "left").withColumn("parts", parts).withColumn("slice", F.pmod(F.hash("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("block", F.xxhash64("cluster", "bin", F.least("slice", "other"), F.greatest("slice", "other"))).drop("bin", "elements", "parts", "slice", "other")


def near_duplicates(docs: DataFrame, percent: int = 85, max_elements: int = MAX_ELEMENTS) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), a row for
    each row of docs.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's
    set is its distinct five-word shingles, of the whole text however long. Documents
    whose sets overlap by at least percent are linked; component_id is the smallest
    doc_id reachable. Null and empty texts have an empty set and no links. Rows that
    share a doc_id are one document: it is linked with whatever any of its texts is
    linked with. A null doc_id is never linked, its component_id is null and it is
    kept. Repeated rows and ties change nothing. An empty table gives an empty result;
    other columns, of any name, are ignored."""
    docs = docs.select("doc_id", "text")
    signed = written(docs.mapInArrow(_sign, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "signed")
    whole = signed.filter("n_shingles > 0 and doc_id is not null")
    # Numbered before they are written, so that the numbers stay.
    classes = whole.groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    slots = classes.select("node", F.explode("bands").alias("band"))
    hubs = slots.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    edges = hot_join(slots, hubs, ["band"], SLOTS // ROWS * classes.count()).filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    coarse = written(components(edges), "coarse")
    tidy(docs.sparkSession)
    members = coarse.join(classes.drop("bands", "n"), "node").withColumnRenamed("component", "cluster")
    sets = _blocks(members, percent, max_elements).join(docs.filter("text is not null"), F.col("rep") == F.col("doc_id"))
    sets = sets.select("text", "node", "s1", "s2", "block").mapInArrow(_sets, "node long, block long, shingles binary")
    dealt = sets.repartition("block").sortWithinPartitions("block")
    links = written(dealt.mapInArrow(_compare(percent), "a long, b long").unionByName(_same_id(whole, classes)), "confirmed")
    found = written(components(links), "found")
    # A component's name is the smallest doc_id of its classes.
    rooted = found.join(classes.select("node", "rep"), "node").withColumnRenamed("component", "root")
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    named = hot_join(rooted.select("node", "root"), named, ["root"], found.count()).select("node", "component_id")
    final = classes.join(named, "node", "left").select(*KEY, "n", F.coalesce("component_id", "rep").alias("component_id"))
    rows = whole.select("doc_id", *KEY)
    out = hot_join(rows, final, KEY, signed.count()).select("doc_id", "n_shingles", "component_id")
    empty = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
