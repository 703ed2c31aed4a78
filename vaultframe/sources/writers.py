"""Archive writers: rows of one archive to its bytes."""

from __future__ import annotations

import bz2
import datetime as dt
import gzip
import io
import struct
import tarfile
import zlib
from dataclasses import dataclass

from vaultframe.functions.codecs import DEFAULT, LZMA_PROPERTIES, Context, check_level
from vaultframe.functions.times import EPOCH, tar_name, to_dos
from vaultframe.sources.model import Unsupported
from vaultframe.sources.sevenzip import write_sevenzip


@dataclass(frozen=True)
class WriteOptions:
    codec: str | None = None
    level: int | None = None
    comment: str = ""
    zip64: bool = False
    tar_format: str = "gnu"
    finalize: bool = True
    compressed_header: bool = False
    streaming: bool = False
    #: Of 7z's LZMA and LZMA2.
    dictionary: int = 1 << 20
    fast_bytes: int = 32


@dataclass(frozen=True)
class Item:
    key: str
    content: bytes | None
    modified: dt.datetime | None = None
    codec: str | None = None
    level: int | None = None
    comment: str = ""


_ZIP_METHOD = {"none": 0, "deflate": 8, "bzip2": 12, "lzma": 14, "zstd": 93}


def write_zip(items: list[Item], o: WriteOptions = WriteOptions()) -> bytes:
    """With the fields of zip64 where they are asked for, and where a count, a size or an
    offset doesn't fit the others."""
    out, central, count = io.BytesIO(), io.BytesIO(), 0
    for x in items:
        folder = x.content is None
        name = x.key.replace("\\", "/").lstrip("/").rstrip("/") + "/" if folder else x.key.replace("\\", "/").lstrip("/")
        codec = "none" if folder else x.codec or o.codec or "deflate"
        if codec not in _ZIP_METHOD:
            raise Unsupported(f"zip isn't written with {codec}")
        body = x.content or b""
        level = x.level if x.level is not None else o.level
        check_level(DEFAULT.get(codec), None if folder else level)
        if codec == "lzma":
            packed = b"\x09\x14" + struct.pack("<H", 5) + LZMA_PROPERTIES + DEFAULT.get("lzma").compress(body, Context(properties=LZMA_PROPERTIES))
        else:
            packed = DEFAULT.get(codec).compress(body, Context(level=None if codec in ("none", "bzip2") else level))
        raw, note = name.encode(), x.comment.encode()
        flags = (0 if name.isascii() and x.comment.isascii() else 0x800) | (8 if o.streaming and not folder else 0) | (2 if codec == "lzma" else 0)
        crc, when, at = zlib.crc32(body), to_dos(x.modified or dt.datetime(1980, 1, 1)), out.tell()
        large = max(len(body), len(packed), at) >= 0xFFFFFFFF
        version = 45 if o.zip64 else max(45 if large else 0, {0: 20, 8: 20, 12: 46, 14: 63, 93: 63}[_ZIP_METHOD[codec]])
        wide = struct.pack("<HHQQ", 1, 16, len(body), len(packed)) if large or o.zip64 and not o.streaming else b""
        sizes = (0xFFFFFFFF, 0xFFFFFFFF) if wide else (len(packed), len(body))
        late = bool(flags & 8)
        out.write(struct.pack("<IHHHIIIIHH", 0x04034B50, version, flags, _ZIP_METHOD[codec], when, *((0, 0, 0) if late else (crc, *sizes)), len(raw), len(wide)) + raw + wide + packed)
        if late:
            out.write(struct.pack("<IIQQ" if wide else "<IIII", 0x08074B50, crc, len(packed), len(body)))
        big = struct.pack("<HHQQQ", 1, 24, len(body), len(packed), at) if wide else b""
        central.write(struct.pack("<IHHHHIIIIHHHHHII", 0x02014B50, version, version, flags, _ZIP_METHOD[codec], when, crc, *sizes, len(raw), len(big), len(note), 0, 0, 16 if folder else 0, 0xFFFFFFFF if wide else at) + raw + big + note)
        count += 1
    start, directory = out.tell(), central.getvalue()
    out.write(directory)
    if o.zip64 or count >= 0xFFFF or max(start, len(directory)) >= 0xFFFFFFFF:
        at = out.tell()
        out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, len(directory), start) + struct.pack("<IIQI", 0x07064B50, 0, at, 1))
    few = min(count, 0xFFFF)
    note = o.comment.encode()
    out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, few, few, min(len(directory), 0xFFFFFFFF), min(start, 0xFFFFFFFF), len(note)) + note)
    return out.getvalue()


def write_tar(items: list[Item], o: WriteOptions = WriteOptions()) -> bytes:
    codec = o.codec or "none"
    if codec not in ("none", "gzip", "bzip2", "lzip"):
        raise Unsupported(f"tar isn't written with {codec}")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT if o.tar_format == "ustar" else tarfile.GNU_FORMAT) as tar:
        for x in items:
            m = tarfile.TarInfo(tar_name(x.key) + ("/" if x.content is None else ""))
            m.mode, m.mtime = 0o777, int(((x.modified or EPOCH) - EPOCH).total_seconds())
            if x.content is None:
                m.type = tarfile.DIRTYPE
            m.size = len(x.content or b"")
            tar.addfile(m, io.BytesIO(x.content or b""))
        end = tar.offset
    raw = out.getvalue()[:end] + (bytes(1024) if o.finalize else b"")
    if codec == "gzip":
        return gzip.compress(raw, 6 if o.level is None else o.level, mtime=0)
    return bz2.compress(raw) if codec == "bzip2" else DEFAULT.get("lzip").compress(raw) if codec == "lzip" else raw


def write_gzip(items: list[Item], o: WriteOptions = WriteOptions()) -> bytes:
    if len(items) != 1 or items[0].content is None:
        raise Unsupported("gzip holds a single file")
    x, out = items[0], io.BytesIO()
    with gzip.GzipFile(filename=x.key.rsplit("/", 1)[-1], mode="wb", fileobj=out, compresslevel=6 if o.level is None else o.level, mtime=int(((x.modified or EPOCH) - EPOCH).total_seconds())) as g:
        g.write(x.content)
    return out.getvalue()


def write(kind: str, items: list[Item], o: WriteOptions = WriteOptions()) -> bytes:
    kind = kind.lower()
    if kind == "zip":
        return write_zip(items, o)
    if kind == "tar":
        return write_tar(items, o)
    if kind == "gzip":
        return write_gzip(items, o)
    if kind in ("7z", "sevenzip"):
        return write_sevenzip([(x.key, x.content, x.modified) for x in items], o.codec or "lzma", o.compressed_header, o.dictionary, o.fast_bytes)
    raise Unsupported(f"{kind} isn't written")


EXTENSION = {"zip": "zip", "tar": "tar", "gzip": "gz", "7z": "7z", "sevenzip": "7z"}
