"""Shared plumbing of the corpus operators: Arrow batches of texts as flat numpy
arrays, word segmentation and hashing on raw UTF-8, streaming of sorted groups, and
tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
BASE = U(0x2545F4914F6CDD1D)
#: Bytes of text that one numpy step works on at once; a longer text is a step alone.
CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and all runs in one process
    (tests), one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not where:
        where = getattr(spark, "_vaultframe_dir", None) or tempfile.mkdtemp(prefix="vaultframe-")
        spark._vaultframe_dir = where
    return where.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the shared folder's owner cleans up
        pass


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts the lineage so
    that lost executors cost no earlier stage. Removed when the driver ends, or by
    done()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vaultframe/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vaultframe_path = path
    return out


def tidy(spark: SparkSession) -> None:
    """Frees what the driver holds of plans and broadcasts that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def done(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes written tables that nothing will read again, and lets Spark remove the
    shuffle files of what is no longer referred to."""
    for x in tables:
        _drop(spark, x._vaultframe_path)
    for _ in range(2):  # references go first, then what they held
        tidy(spark)
        time.sleep(0.2)


class Texts:
    """Consecutive rows of a batch: the texts' bytes in one array, with offsets."""

    __slots__ = ("data", "hi", "lo", "offs")

    def __init__(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int):
        self.data, self.offs, self.lo, self.hi = data, offs, lo, hi

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """A string column in runs of rows of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Texts(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo, hi)
        lo = hi


class Words:
    """The words of some texts, in order: starts and ends in the bytes, and per text
    the range first[i]:first[i + 1] of its words."""

    __slots__ = ("doc", "ends", "first", "hash", "starts")

    def __init__(self, t: Texts, inside: np.ndarray, symbol: np.ndarray | None = None):
        """inside: which of the 256 bytes words consist of; symbol: a 64-bit value for
        each byte if the words' hashes are wanted."""
        n = len(t.data)
        flags = np.zeros(n + 2, bool)
        flags[1 : n + 1] = inside[t.data]
        begin = flags[1 : n + 1] & ~flags[:n]
        end = flags[1 : n + 1] & ~flags[2:]
        edge = t.offs[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begin[edge] = flags[edge + 1]
        end[edge - 1] = flags[edge]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, t.offs)
        self.doc = np.repeat(np.arange(len(t), dtype=np.int32), np.diff(self.first))
        self.hash = hashes(t.data, self.starts, self.ends, symbol) if symbol is not None else None


_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
_INVERSE = U(pow(int(BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for i, b in enumerate((BASE, _INVERSE)):
            x = np.full(size, b, U)
            x[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[i] = np.cumprod(x, dtype=U)
    return _POWERS[0], _POWERS[1]


def symbols(fold: np.ndarray = LOWER, seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte after folding."""
    return mix64((np.arange(256, dtype=U) + U(seed)) * GOLD)[fold]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], by prefix sums of a polynomial."""
    n = len(data)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U)
        np.cumsum(symbol[data] * up[:n], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * GOLD)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive elements; k - 1 fewer than h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = h[:n] * U(3)
        for j in range(1, k):
            out = (out ^ (out >> U(29))) * BASE + h[j : j + n]
    return mix64(out)


def mapped(df: DataFrame, step: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(step, schema)


def batch(schema: str | pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of the given Arrow schema from numpy arrays, lists or Arrow arrays."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal key from batches sorted by it, whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and k[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = k[lo]
    if held:
        yield pa.Table.from_batches(held)


def packs(batches: Iterable[pa.RecordBatch], key: str, limit: int) -> Iterator[pa.Table]:
    """Whole groups of equal key, several together up to about limit bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), b.num_rows]
        each = b.nbytes / b.num_rows
        lo = 0
        for c in cuts[:-1]:
            if (size + (c - lo) * each > limit) and (c > lo or held) and (c > 0 or k[0] != last):
                if c > lo:
                    held.append(b.slice(lo, c - lo))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, lo = [], 0, c
        held.append(b.slice(lo))
        size += (b.num_rows - lo) * each
        last = k[-1]
    if held:
        yield pa.Table.from_batches(held)


class UnionFind:
    """Smallest member as root, over arbitrary integers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
