"""Bounded decompression, sinks that keep what they should, volumes, and metadata that
costs no contents."""

import bz2
import gzip
import io
import lzma
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from vaultframe.functions import checksums, filters
from vaultframe.functions.codecs import DEFAULT, Context, TooLarge
from vaultframe.operators.inspect import inspect
from vaultframe.sources import archive, detect
from vaultframe.sources.model import Options
from vaultframe.sources.writers import Item, WriteOptions, write
from vaultframe.streaming.landing import entries_stream

BOMB = bytes(5_000_000)


def packed(name):
    make = {"xz": lambda x: lzma.compress(x, lzma.FORMAT_XZ), "zstd": zstandard.ZstdCompressor().compress}
    return make.get(name, DEFAULT.get(name).compress)(BOMB)


@pytest.mark.parametrize("name", ["deflate", "zlib", "gzip", "bzip2", "lzma", "lzma2", "lzip", "xz", "zstd", "none"])
def test_output_is_bounded(name):
    data = packed(name)
    with pytest.raises(TooLarge):
        DEFAULT.get(name).decompress(data, Context(limit=1000))
    assert DEFAULT.get(name).decompress(data, Context(limit=len(BOMB))) == BOMB
    assert DEFAULT.get(name).decompress(data) == BOMB


def test_lying_and_swollen_archives():
    z = bytearray(write("zip", [Item("x", BOMB)], WriteOptions(codec="deflate")))
    for mark, at in ((b"PK\x03\x04", 22), (b"PK\x01\x02", 24)):
        struct.pack_into("<I", z, z.find(mark) + at, 10)
    few = Options(max_entry_bytes=1000, max_ratio=10, max_whole_bytes=1000)
    cases = [(bytes(z), Options()), (gzip.compress(BOMB), few), (write("7z", [Item("x", BOMB)]), few), (write("zip", [Item("x", BOMB)]), few)]
    cases += [(write("tar", [Item("x", b"y" * 500_000)], WriteOptions(codec=c)), few) for c in ("gzip", "bzip2", "lzip")]
    for data, o in cases:
        with pytest.raises(ValueError):
            [e.content() for e in detect.entries(data, o)]


def test_gzip_of_several_members_and_of_zeros():
    (e,) = detect.entries(gzip.compress(b"first", mtime=0) + gzip.compress(b"second", mtime=0))
    assert (e.content(), e.size, e.check) == (b"firstsecond", None, None)
    (e,) = detect.entries(gzip.compress(bytes(4096)))
    assert (e.archive_type, e.size, e.content()) == ("GZip", 4096, bytes(4096))
    empty = gzip.compress(bytes(10240))
    assert list(detect.entries(empty, Options(extension=detect.extension_of("/a/b.tar.gz")))) == []
    inside = os.urandom(200) + b"\x1f\x8b\x08" + os.urandom(300)
    (e,) = detect.entries(gzip.compress(inside, 0))
    assert e.size == len(inside) and e.check(e.content()) == e.crc


def two_disks():
    """A split zip whose second entry lies on the second disk."""
    def local(name, body):
        return struct.pack("<IHHHIIIIHH", 0x04034B50, 20, 0, 0, 0, zlib.crc32(body), len(body), len(body), len(name), 0) + name + body

    def central(name, body, disk, at):
        return struct.pack("<IHHHHIIIIHHHHHII", 0x02014B50, 20, 20, 0, 0, 0, zlib.crc32(body), len(body), len(body), len(name), 0, 0, disk, 0, 0, at) + name

    a, b = b"first" * 30, b"second" * 30
    one = b"PK\x07\x08" + local(b"a", a)
    two = b"tail" + local(b"b", b)
    directory = central(b"a", a, 0, 4) + central(b"b", b, 1, 4)
    return one, two + directory + struct.pack("<IHHHHIIH", 0x06054B50, 1, 1, 1, 2, len(directory), len(two), 0)


def test_split_zip_by_disk(spark, tmp_path):
    one, two = two_disks()
    (tmp_path / "s.z01").write_bytes(one)
    (tmp_path / "s.zip").write_bytes(two)
    (tmp_path / "other.zip").write_bytes(write("zip", [Item("c", b"third")]))
    archive.register(spark)
    want = {("a", b"first" * 30), ("b", b"second" * 30), ("c", b"third")}
    for df in (spark.read.format("archive").load(str(tmp_path)), archive.read_archives(spark, str(tmp_path))):
        assert {(r.key, bytes(r.content)) for r in df.collect()} == want


def test_sink_appends_and_overwrites(spark, tmp_path):
    archive.register(spark)
    where = str(tmp_path / "out")

    def put(mode, *keys):
        df = spark.createDataFrame([(k, k.encode()) for k in keys], "key string, content binary")
        df.repartition(len(keys)).write.format("archive").mode(mode).option("type", "zip").save(where)

    def keys():
        return sorted(r.key for r in spark.read.format("archive").load(where).select("key").collect())

    put("append", "a", "b")
    put("append", "a", "c")
    assert keys() == ["a", "a", "b", "c"]
    put("overwrite", "z")
    assert keys() == ["z"] and not os.path.exists(os.path.join(where, "_temporary"))
    bad = spark.createDataFrame([("k", b"x", "no such codec")], "key string, content binary, codec string")
    with pytest.raises(Exception):
        bad.write.format("archive").mode("append").option("type", "zip").save(where)
    assert keys() == ["z"] and not os.path.exists(os.path.join(where, "_temporary"))


class Touched(bytes):
    read = 0

    def __getitem__(self, at):
        out = super().__getitem__(at)
        Touched.read += len(out) if isinstance(at, slice) else 1
        return out


@pytest.mark.parametrize("kind", ["zip", "7z", "tar"])
def test_metadata_reads_headers_alone(kind, spark, tmp_path):
    items = [Item(f"{i}.bin", os.urandom(200_000)) for i in range(20)]
    data = write(kind, items)
    Touched.read = 0
    rows = list(archive.rows_of("x", Touched(data), Options(), False))
    assert len(rows) == 20 and Touched.read < (200_000 if kind == "tar" else 90_000)
    (tmp_path / f"big.{kind}").write_bytes(data)
    archive.register(spark)
    df = spark.read.format("archive").option("partitionBytes", 1 << 20).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4
    assert sorted((r.key, bytes(r.content)) for r in df.collect()) == sorted((x.key, x.content) for x in items)


def test_inspection_fields(spark):
    made = [("zip", write("zip", [Item("a", b"x" * 900), Item("b", b"y")], WriteOptions(comment="note"))), ("7z", write("7z", [Item("a", b"x" * 900), Item("b", b"y" * 50)]))]
    rows = {r.archive_path: r for r in inspect(archive.explode_archives(spark.createDataFrame([(k, bytearray(d)) for k, d in made], "path string, content binary"), content=False)).collect()}
    assert (rows["zip"].comment, rows["7z"].comment, rows["zip"].status) == ("note", None, "Complete")
    assert {k: rows[k].physical_size for k in rows} == {k: len(d) for k, d in made}
    head = struct.unpack_from("<Q", dict(made)["7z"], 12)[0]
    assert rows["7z"].compressed_payload_size == head and rows["zip"].compressed_payload_size == sum(x.compress_size for x in zipfile.ZipFile(io.BytesIO(made[0][1])).infolist())


def test_riscv_round_trip_and_targets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        words = rng.integers(0, 1 << 32, 64, np.uint64).astype("<u4")
        kinds = rng.integers(0, 4, 64)
        words = np.where(kinds == 0, words & 0xFFFFF000 | 0x0EF, np.where(kinds == 1, words & 0xFFFFF000 | 0x297, np.where(kinds == 2, words & 0xFFF07FFF | 0x28003, words))).astype("<u4")
        data = words.tobytes() + bytes(rng.integers(0, 256, int(rng.integers(0, 9))).astype(np.uint8))
        coded = filters.apply("riscv", data, True, start=0)
        assert filters.apply("riscv", coded, False) == data
    # jal ra, +16 at two places: absolute targets differ by the distance.
    jal = struct.pack("<I", 0x010000EF)
    coded = filters.apply("riscv", jal + bytes(12) + jal + bytes(8), True)
    to = [int.from_bytes(bytes([coded[i + 1] >> 4, coded[i + 2], coded[i + 3]]), "big") * 2 for i in (0, 16)]
    assert to == [16, 32]


def test_checksums_in_lanes():
    rng = np.random.default_rng(5)
    for n in (0, 1, 4095, 4096, 5000, 70_001):
        data = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert checksums.crc32_custom(data) == zlib.crc32(data)
        slow = 0
        for b in data:
            slow = checksums._table(0xA001, 0xFFFF)[(slow ^ b) & 255] ^ (slow >> 8)
        assert checksums.crc16_arc(data) == slow
    block = bz2.compress(b"hello world")
    assert checksums.bzip2_crc(b"hello world") == int.from_bytes(block[10:14], "big")


@pytest.mark.parametrize("n", [65534, 65535, 65536, 70000])
@pytest.mark.parametrize("streaming", [False, True])
def test_zip_of_more_entries_than_16_bits_count(n, streaming):
    data = write("zip", [Item(f"{i}", b"%d" % i) for i in range(n)], WriteOptions(codec="none", streaming=streaming))
    assert [e.key for e in detect.entries(data)] == [f"{i}" for i in range(n)]
    assert (b"PK\x06\x06" in data) == (n >= 65535)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert len(z.namelist()) == n and z.read(f"{n - 1}") == b"%d" % (n - 1)


@pytest.mark.parametrize("count", [0xFFFF, 70000 & 0xFFFF])
def test_landed_zips_whose_count_is_too_small(spark, tmp_path, count):
    n = 70000
    data = bytearray(write("zip", [Item(f"{i}", b"x") for i in range(n)], WriteOptions(codec="none")))
    end = data.rfind(b"PK\x05\x06")
    start = struct.unpack_from("<I", data, end + 16)[0]
    struct.pack_into("<HH", data, end + 8, count, count)
    narrow = bytes(data[: end - 76] + data[end:])  # without zip64's two records
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(narrow)
    assert start == narrow.find(b"PK\x01\x02")
    entries = entries_stream(spark, str(tmp_path / "in"), glob="*.zip")
    q = entries.select("key", "error").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.count("*"), F.count_distinct("key"), F.count("error")).first() == (n, n, 0)
