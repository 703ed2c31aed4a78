"""Formats: round trips, what other libraries write, damage, and safety."""

import datetime as dt
import io
import os
import struct
import tarfile
import zipfile
import zlib

import pytest

from vaultframe.functions import checksums, crypto
from vaultframe.operators.build import build_archives
from vaultframe.operators.extract import Extraction, extract
from vaultframe.operators.inspect import inspect
from vaultframe.operators.mutate import add, remove
from vaultframe.sources import archive, detect, sevenzip
from vaultframe.sources.formats import zip_comment
from vaultframe.sources.model import ArchiveError, Options, Unsupported
from vaultframe.sources.writers import Item, WriteOptions, write

WHEN = dt.datetime(2021, 3, 4, 5, 6, 8)
ITEMS = [Item("a/x.txt", b"hello" * 100, WHEN), Item("d", None), Item("é.bin", os.urandom(5000), WHEN), Item("empty", b"", WHEN)]
CONTENTS = {x.key: x.content for x in ITEMS if x.content is not None}


def read(data, o=Options()):
    out = {}
    for e in detect.entries(data, o):
        if not e.is_directory:
            body = e.content()
            assert e.check is None or e.check(body) == e.crc
            out[e.key] = body
    return out


@pytest.mark.parametrize("codec", ["none", "deflate", "bzip2", "lzma", "zstd"])
@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("streaming", [False, True])
def test_zip(codec, zip64, streaming):
    data = write("zip", ITEMS, WriteOptions(codec=codec, zip64=zip64, streaming=streaming, comment="note"))
    assert read(data) == CONTENTS == read(data, Options(streaming=True))
    assert zip_comment(data) == "note"
    assert read(b"stub" * 50 + data, Options(look_for_header=True)) == CONTENTS
    if codec != "zstd":
        assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None


def test_zip_from_elsewhere_and_encrypted():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"y" * 1000)
    assert read(out.getvalue()) == {"x": b"y" * 1000}
    body = zlib.compress(b"secret" * 50)[2:-4]
    for flags, method, extra, packed, crc in (
        (1, 8, b"", crypto.zipcrypto(bytes(11) + bytes([zlib.crc32(b"secret" * 50) >> 24]) + body, b"test", encrypt=True), zlib.crc32(b"secret" * 50)),
        (1, 99, struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", 3, 8), crypto.winzip_encrypt(body, b"test", 3, bytes(16)), 0),
    ):
        local = struct.pack("<IHHHIIIIHH", 0x04034B50, 20, flags, method, 0, crc, len(packed), 300, 1, len(extra)) + b"s" + extra + packed
        central = struct.pack("<IHHHHIIIIHHHHHII", 0x02014B50, 20, 20, flags, method, 0, crc, len(packed), 300, 1, len(extra), 0, 0, 0, 0, 0) + b"s" + extra
        data = local + central + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 1, 1, len(central), len(local), 0)
        assert read(data, Options(password="test")) == {"s": b"secret" * 50}
        with pytest.raises(ArchiveError):
            read(data)
        with pytest.raises(ValueError):
            read(data, Options(password="wrong"))


@pytest.mark.parametrize("codec", ["none", "gzip", "bzip2", "lzip"])
def test_tar(codec):
    data = write("tar", [*ITEMS, Item("n" * 180, b"long", WHEN)], WriteOptions(codec=codec))
    assert read(data) == CONTENTS | {"n" * 180: b"long"}
    e = next(iter(detect.entries(data)))
    assert (e.last_modified, e.format_meta["mode"], e.archive_type) == (WHEN, "511", "Tar")


def test_tar_dialects_and_links():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:xz", format=tarfile.PAX_FORMAT) as t:
        m = tarfile.TarInfo("ü" * 120)
        m.size = 3
        t.addfile(m, io.BytesIO(b"abc"))
        m = tarfile.TarInfo("link")
        m.type, m.linkname = tarfile.SYMTYPE, "target"
        t.addfile(m)
    es = list(detect.entries(out.getvalue()))
    assert [(e.key, e.link_target, e.outer_compression) for e in es] == [("ü" * 120, None, "Xz"), ("link", "target", "Xz")]
    assert es[0].content() == b"abc"


@pytest.mark.parametrize("codec", ["lzma", "lzma2"])
@pytest.mark.parametrize("packed", [False, True])
def test_sevenzip(codec, packed):
    data = write("7z", ITEMS, WriteOptions(codec=codec, compressed_header=packed))
    assert read(data) == CONTENTS
    assert read(write("7z", [])) == {}
    with pytest.raises(ArchiveError):
        read(data[:-3])


def test_sevenzip_solid():
    """A folder of two files behind one LZMA2 stream, put together by hand."""
    import lzma

    a, b = b"first" * 40, b"second" * 40
    body = lzma.compress(a + b, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])
    n = sevenzip._number
    head = b"\x01\x04\x06" + n(0) + n(1) + b"\x09" + n(len(body)) + b"\0" + b"\x07\x0b" + n(1) + b"\0" + n(1) + b"\x21\x21\x01\x10" + b"\x0c" + n(len(a + b)) + b"\0"
    head += b"\x08\x0d" + n(2) + b"\x09" + n(len(a)) + b"\x0a\x01" + struct.pack("<II", zlib.crc32(a), zlib.crc32(b)) + b"\0\0"
    names = b"\0" + "".join(x + "\0" for x in "ab").encode("utf-16-le")
    head += b"\x05" + n(2) + b"\x11" + n(len(names)) + names + b"\0\0"
    start = struct.pack("<QQI", len(body), len(head), zlib.crc32(head))
    data = sevenzip.MAGIC + b"\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + head
    es = list(detect.entries(data))
    assert [(e.key, e.is_solid, e.folder) for e in es] == [("a", False, 0), ("b", True, 0)]
    assert read(data) == {"a": a, "b": b}


def test_gzip_arc_arj_ace_rar_stored():
    e = next(iter(detect.entries(write("gzip", ITEMS[:1]))))
    assert (e.key, e.size, e.last_modified, e.content()) == ("x.txt", 500, WHEN, b"hello" * 100)
    with pytest.raises(Unsupported):
        write("gzip", ITEMS)
    body = b"stored bytes"
    arc = b"\x1a\x02" + b"NAME.TXT".ljust(13, b"\0") + struct.pack("<IHHHI", len(body), 0x5021, 0, checksums.crc16_arc(body), len(body)) + body + b"\x1a\0"
    assert read(arc) == {"NAME.TXT": body}

    def arj(kind, name, packed=b""):
        head = bytes([30, 11, 1, 0, 0, 0, kind, 0]) + struct.pack("<IIIIHHH", 0x50210000, len(packed), len(packed), zlib.crc32(packed), 0, 0, 0) + name + b"\0\0"
        return b"\x60\xea" + struct.pack("<H", len(head)) + head + struct.pack("<I", zlib.crc32(head)) + b"\0\0" + packed

    assert read(arj(2, b"arc") + arj(0, b"f.txt", body) + b"\x60\xea\0\0") == {"f.txt": body}

    def ace(head):
        return struct.pack("<HH", checksums.ace_header_crc(head), len(head)) + head

    main = ace(b"\0\0\0**ACE**" + bytes(20))
    entry = ace(b"\x01\x01\0" + struct.pack("<IIIII", len(body), len(body), 0x50210000, 0, checksums.crc32_raw(body)) + b"\0\x03\0\0\0\0" + struct.pack("<H", 5) + b"f.txt")
    assert read(main + entry + body) == {"f.txt": body}

    def block(crc_over):
        return struct.pack("<H", zlib.crc32(crc_over) & 0xFFFF) + crc_over

    name = b"f.txt"
    rar4 = b"Rar!\x1a\x07\0" + block(struct.pack("<BHH6x", 0x73, 0, 13)) + block(struct.pack("<BHHIIBIIBBHI", 0x74, 0x8000, 32 + len(name), len(body), len(body), 2, zlib.crc32(body), 0x50210000, 20, 0x30, len(name), 32) + name) + body
    assert read(rar4) == {"f.txt": body}

    def five(head):
        x = bytes([len(head)]) + head
        return struct.pack("<I", zlib.crc32(x)) + x

    rar5 = b"Rar!\x1a\x07\x01\0" + five(b"\x01\0\0") + five(bytes([2, 2, len(body), 4, len(body), 0]) + struct.pack("<I", zlib.crc32(body)) + bytes([0, 0, len(name)]) + name) + body + five(b"\x05\0\0")
    assert read(rar5) == {"f.txt": body}


class Writer:
    """Bits, highest first, and RAR 5 blocks with codes of fixed lengths: enough to test
    the decoder with, though not by anyone else's encoder."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def tables(self):
        for _ in range(20):
            self.put(5, 4)
        for n, size in ((306, 9), (64, 6), (16, 4), (44, 6)):
            for _ in range(n):
                self.put(size, 5)

    def block(self, last=True, tables=True):
        n = len(self.bits)
        raw = bytes(int("".join(map(str, self.bits[i : i + 8])).ljust(8, "0"), 2) for i in range(0, n, 8))
        flags = (n - 1) % 8 | 1 << 3 | (0x40 if last else 0) | (0x80 if tables else 0)
        size = struct.pack("<H", len(raw))
        return bytes([flags, 0x5A ^ flags ^ size[0] ^ size[1]]) + size + raw


def rar5_packed():
    w = Writer()
    w.tables()
    for c in b"abcdefgh":
        w.put(c, 9)
    w.put(262 + 4, 9), w.put(3, 6)  # length 6, distance 4
    w.put(257, 9)  # the same again
    w.put(262 + 8, 9), w.put(1, 1), w.put(5, 6), w.put(0, 1)  # length 2 + 8 + 1, distance 1 + 6
    w.put(259, 9), w.put(2, 6)  # the distance before, length 4
    out = bytearray(b"abcdefgh")
    for d, n in ((4, 6), (4, 6), (7, 11), (4, 4)):
        out += _copied(out, d, n)
    return w.block(), bytes(out)


def _copied(done, distance, n):
    out = bytearray(done)
    for _ in range(n):
        out.append(out[-distance])
    return out[len(done) :]


def test_rar5_compressed_solid_and_encrypted():
    packed, plain = rar5_packed()
    second = Writer()
    for c in b"xyz":
        second.put(c, 9)
    second.put(262 + 1, 9), second.put(2, 6)
    more = second.block(tables=False)
    tail = b"xyz" + bytes(_copied(plain + b"xyz", 3, 3))

    def vint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + vint(n >> 7)

    def five(head):
        x = vint(len(head)) + head
        return struct.pack("<I", zlib.crc32(x)) + x

    def entry(name, body, content, method, extra=b""):
        fields = (vint(len(extra)) if extra else b"") + vint(len(body)) + b"\x04" + vint(len(content)) + b"\0" + struct.pack("<I", zlib.crc32(content)) + vint(method) + bytes([0, len(name)]) + name + extra
        return five(bytes([2, 3 if extra else 2]) + fields) + body

    start = b"Rar!\x1a\x07\x01\0" + five(b"\x01\0\0")
    data = start + entry(b"a", packed, plain, 1 << 7) + entry(b"b", more, tail, 1 << 7 | 64) + five(b"\x05\0\0")
    assert read(data) == {"a": plain, "b": tail}
    assert list(detect.entries(data))[1].content() == tail  # alone: those before it are decoded first
    # Over two volumes: the first part carries on in the second.
    whole = b"first half, second half"

    def part(flags, body, content):
        fields = vint(len(body)) + b"\x04" + vint(len(whole)) + b"\0" + struct.pack("<I", zlib.crc32(content)) + b"\0" + bytes([0, 1]) + b"v"
        return five(bytes([2, 2 | flags]) + fields) + body

    one, two = start + part(16, whole[:11], whole[:11]) + five(b"\x05\0\x01"), start + part(8, whole[11:], whole) + five(b"\x05\0\0")
    assert read(one + two) == {"v": whole}
    e = next(iter(detect.entries(one + two)))
    assert (e.volume_index_first, e.volume_index_last, e.is_complete, e.compressed_size) == (0, 1, True, len(whole))
    assert not next(iter(detect.entries(one))).is_complete
    salt, iv = bytes(range(16)), bytes(range(16, 32))
    body = crypto.aes_cbc_encrypt(crypto.rar5_key("test", salt, 4), iv, b"sixteen letters!")
    extra = bytes([1, 0, 1, 4]) + salt + iv + crypto.rar5_check("test", salt, 4) + bytes(4)
    data = start + entry(b"s", body, b"sixteen letters!", 0, bytes([len(extra)]) + extra) + five(b"\x05\0\0")
    assert read(data, Options(password="test")) == {"s": b"sixteen letters!"}
    with pytest.raises(crypto.BadPassword):
        read(data, Options(password="no"))


def test_detection_and_volumes():
    assert detect.detect(b"nothing known here") is None and detect.detect(b"") is None
    assert detect.detect(write("tar", ITEMS, WriteOptions(codec="gzip")), Options(extension=".gz")) == "Tar"
    assert detect.volumes(["a.part2.rar", "a.part1.rar", "b.z01", "b.zip", "c.002", "c.001", "d.r00", "d.rar"]) == {"a.part.rar": ["a.part1.rar", "a.part2.rar"], "b.zip": ["b.z01", "b.zip"], "c": ["c.001", "c.002"], "d.rar": ["d.rar", "d.r00"]}
    with pytest.raises(ArchiveError):
        list(detect.entries(b"nothing"))


def test_source_options_and_damage(spark, tmp_path):
    archive.register(spark)
    data = write("zip", ITEMS)
    broken = bytearray(data)
    broken[45] ^= 0xFF
    (tmp_path / "a.zip").write_bytes(data)
    (tmp_path / "b.zip").write_bytes(bytes(broken))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    (tmp_path / "s.zip.001").write_bytes(data[:300])
    (tmp_path / "s.zip.002").write_bytes(data[300:])
    rows = spark.read.format("archive").option("onError", "null").load(str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(os.path.basename(r.archive_path), []).append(r)
    assert [r.error for r in by["a.zip"]] == [None] * 4 and all(r.checksum_ok for r in by["a.zip"] if not r.is_directory)
    assert sum(r.error is not None or r.checksum_ok is False for r in by["b.zip"]) == 1
    assert len(by["c.zip"]) == 1 and "format" in by["c.zip"][0].error
    assert len(by["s.zip"]) == 4
    one = spark.read.format("archive").option("key", "a/x.txt").option("content", "false").load(str(tmp_path / "a.zip"))
    assert one.count() == 1 and "content" not in one.columns
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert spark.read.format("archive").option("pushdown", "true").load(str(tmp_path / "a.zip")).filter("key = 'empty'").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert archive.read_archives(spark, str(tmp_path), on_error="null", glob="*.zip*").filter("archive_path like '%s.zip' or archive_path like '%a.zip'").count() == 8


def test_extract_guards(spark, tmp_path):
    files = spark.createDataFrame([("p", "a/b.txt", b"1"), ("p", "c.txt", b"2")], "pack string, key string, content binary")
    made = build_archives(files, "pack", "tar")
    e = archive.explode_archives(made.selectExpr("pack as path", "archive as content"))
    assert {r.key: r.bytes for r in extract(e, str(tmp_path / "out")).collect()} == {"a/b.txt": 1, "c.txt": 1}
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"1"
    with pytest.raises(Exception, match="FileExistsError"):
        extract(e, str(tmp_path / "out"), Extraction(overwrite=False)).collect()
    evil = e.selectExpr("* except (key)", "concat('../', key) as key")
    with pytest.raises(ValueError, match="leave"):
        extract(evil, str(tmp_path / "out2"))
    assert not (tmp_path / "out2").exists()


def test_mutation_and_inspection(spark):
    made = build_archives(spark.createDataFrame([("p", f"k{i}", b"x" * i) for i in range(5)], "pack string, key string, content binary"), "pack")
    e = archive.explode_archives(made.selectExpr("pack as path", "archive as content"))
    left = remove(e, e.filter("key = 'k2'"))
    new = spark.createDataFrame([("p", "/new", 7)], "archive_path string, key string, size long")
    out = add(left, new)
    assert [(r.entry_index, r.key) for r in out.orderBy("entry_index").collect()] == [(0, "k0"), (1, "k1"), (3, "k3"), (4, "k4"), (5, "new")]
    with pytest.raises(ValueError):
        add(e, spark.createDataFrame([("p", "K3", 7)], "archive_path string, key string, size long"))
    r = inspect(e).first()
    assert (r.entry_count, r.uncompressed_payload_size, r.is_solid, r.is_complete) == (5, 10, False, True)


def test_bomb_limit():
    data = write("zip", [Item("big", bytes(1 << 20))])
    with pytest.raises(Unsupported):
        read(data, Options(max_entry_bytes=1000))
    with pytest.raises(Unsupported):
        read(data, Options(max_ratio=10))


