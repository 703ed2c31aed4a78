"""Options of reading, writing and extraction; formats of one's own on all tasks."""

import io
import os
import struct
import tarfile
import zlib

import pytest

from vaultframe.functions.archives import detect_archive, file_parts
from vaultframe.operators.build import build_archives
from vaultframe.operators.extract import Extraction, extract
from vaultframe.operators.inspect import inspect, quarantined, watched
from vaultframe.sources import archive, detect, formats
from vaultframe.sources.model import Entry, Options
from vaultframe.sources.writers import Item, WriteOptions, write


def test_own_formats_reach_the_tasks(spark, tmp_path):
    detect.register("Lines", lambda d, o: d[:6] == b"LINES\n", lambda d, o, r: (Entry("Lines", f"{i}", size=len(x), read=lambda x=x: x) for i, x in enumerate(d[6:].split(b"\n"))), ("lines",))
    try:
        (tmp_path / "a.lines").write_bytes(b"LINES\none\ntwo")
        archive.register(spark)
        files = spark.createDataFrame([("a", bytearray(b"LINES\none\ntwo"))], "path string, content binary").repartition(3)
        for df in (spark.read.format("archive").load(str(tmp_path)), archive.explode_archives(files)):
            assert sorted((r.archive_type, bytes(r.content)) for r in df.collect()) == [("Lines", b"one"), ("Lines", b"two")]
    finally:
        detect.FORMATS.pop("Lines")
        detect.EXTENSIONS.pop("lines")
        archive.register(spark)


def test_detection_struct_and_parts(spark):
    made = {"zip": write("zip", [Item("a", b"x")]), "tgz": write("tar", [Item("a", b"x")], WriteOptions(codec="gzip")), "7z": write("7z", [Item("a", b"x")]), "none": b"nothing"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary")
    got = {r.path: r.d for r in df.select("path", detect_archive(df.content).alias("d")).collect()}
    assert got["none"] is None and got["zip"].supported_apis == ["Archive", "Reader"] and got["7z"].supported_apis == ["Archive"]
    assert (got["tgz"].container_type, got["tgz"].outer_compression_type, got["tgz"].supported_apis) == ("Tar", "GZip", ["Reader"])
    names = ["a.part2.rar", "a.part1.rar", "b.z01", "b.zip", "c.7z.002", "c.7z.001", "d.tar"]
    rows = file_parts(spark.createDataFrame([(n,) for n in names], "path string")).orderBy("whole", "place").collect()
    assert [r.part for r in rows] == ["a.part1.rar", "a.part2.rar", "b.z01", "b.zip", "c.7z.001", "c.7z.002", "d.tar"]
    assert len({r.whole for r in rows}) == 4


def test_encodings_times_and_comments(spark):
    raw = "é".encode("cp1252")
    extra = struct.pack("<HHIHHQQQ", 0x0A, 32, 0, 1, 24, *(116444736000000000 + 10_000_000 * s for s in (1_600_000_000, 1_600_000_100, 1_600_000_200)))
    local = struct.pack("<IHHHIIIIHH", 0x04034B50, 20, 0x800, 0, 0, zlib.crc32(b"x"), 1, 1, 1, 0) + raw + b"x"
    central = struct.pack("<IHHHHIIIIHHHHHII", 0x02014B50, 20, 20, 0x800, 0, 0, zlib.crc32(b"x"), 1, 1, 1, len(extra), 0, 0, 0, 0, 0) + raw + extra
    data = local + central + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 1, 1, len(central), len(local), 0)
    (e,) = formats.zip_entries(data, Options(encoding="cp1252", force_encoding=True))
    assert e.key == "é" and (e.last_modified.minute, e.created - e.last_modified).__str__() == "(26, datetime.timedelta(seconds=200))"
    made = build_archives(spark.createDataFrame([("p", "k", b"x", "a note")], "pack string, key string, content binary, comment string"), "pack")
    (r,) = archive.explode_archives(made.selectExpr("pack as path", "archive as content")).collect()
    assert r.format_meta["comment"] == "a note"


def test_lzma_options():
    data = os.urandom(2000) * 30
    small, large = (write("7z", [Item("x", data)], WriteOptions(dictionary=d, fast_bytes=f)) for d, f in ((1 << 12, 5), (1 << 20, 273)))
    for x in (small, large):
        (e,) = detect.entries(x)
        assert e.content() == data
    with pytest.raises(ValueError):
        write("7z", [Item("x", data)], WriteOptions(fast_bytes=3))


def test_extraction_options(spark, tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        m = tarfile.TarInfo("run:me")
        m.size, m.mode = 2, 0o750
        t.addfile(m, io.BytesIO(b"hi"))
        m = tarfile.TarInfo("link")
        m.type, m.linkname = tarfile.SYMTYPE, "run:me"
        t.addfile(m)
    e = archive.explode_archives(spark.createDataFrame([("a", bytearray(out.getvalue()))], "path string, content binary"))

    def note(path, target):
        with open(path + ".link", "w") as f:
            f.write(target)

    extract(e, str(tmp_path), Extraction(preserve_attributes=True, plain_names=True, link=note, check_first=False)).collect()
    assert os.stat(tmp_path / "run_me").st_mode & 0o777 == 0o750 and (tmp_path / "link.link").read_text() == "run:me"
    evil = e.filter("link_target is null").selectExpr("* except (key)", "concat('../', key) as key")
    with pytest.raises(Exception, match="leave"):
        extract(evil, str(tmp_path), Extraction(check_first=False)).collect()


def test_damage_is_set_apart_and_progress_observed(spark):
    good = write("zip", [Item("a", b"x" * 50)])
    df = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(b"not an archive"))], "path string, content binary")
    fine, broken = quarantined(archive.explode_archives(df, on_error="null"))
    assert [r.key for r in fine.collect()] == ["a"] and [r.archive_path for r in broken.collect()] == ["bad"]
    from pyspark.sql import Observation

    seen = Observation("progress")
    assert watched(archive.explode_archives(df, on_error="null"), seen).count() == 2
    assert seen.get == {"entries": 2, "bytes": 50, "errors": 1}
    r = inspect(fine).first()
    assert (r.status, r.limitations, r.encryption_scope) == ("Complete", "None", "None")
