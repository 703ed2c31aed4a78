"""The codec registry: scalar functions from bytes to bytes, by name, and as columns.

A registry is immutable; with_codec() returns another. Codecs that only decode raise on
compress()."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from types import MappingProxyType

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultframe.functions import legacy, ppmd
from vaultframe.functions.legacy import FormatError


class UnsupportedCodec(ValueError):
    """No such codec, or none that can do this."""


class TooLarge(FormatError):
    """More content than the caller allows."""


@dataclass(frozen=True)
class Context:
    """What a container knows about a stream, and the most bytes it may become."""

    size: int | None = None
    properties: bytes = b""
    flags: int = 0
    level: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Codec:
    name: str
    decode: Callable[[bytes, Context], bytes] | None
    encode: Callable[[bytes, Context], bytes] | None = None
    levels: tuple[int, int] | None = None

    def decompress(self, data: bytes, context: Context = Context()) -> bytes:
        if self.decode is None:
            raise UnsupportedCodec(f"{self.name} can't be decoded")
        try:
            out = self.decode(data, context)
            if context.limit is not None and len(out) > context.limit:
                raise TooLarge(f"{self.name}: content is larger than allowed")
            return out
        except (zlib.error, lzma.LZMAError, OSError, EOFError, zstandard.ZstdError, IndexError, struct.error) as e:
            raise FormatError(f"{self.name}: {e}") from e

    def compress(self, data: bytes, context: Context = Context()) -> bytes:
        if self.encode is None:
            raise UnsupportedCodec(f"{self.name} only decodes")
        check_level(self, context.level)
        return self.encode(data, context)


def check_level(codec: Codec, level: int | None) -> None:
    low, high = codec.levels or (0, 0)
    if level is not None and not low <= level <= high:
        raise ValueError(f"{codec.name} takes levels {low} to {high}, not {level}")


def _raw_deflate(data: bytes, c: Context) -> bytes:
    z = zlib.compressobj(6 if c.level is None else c.level, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


def _streams(new: Callable[[], object], data: bytes, c: Context, several: bool = False) -> bytes:
    """What decompressors make of data, one stream or several after another, never much
    beyond the limit."""
    out, rest = bytearray(), data
    while True:
        z = new()
        while not z.eof:
            room = -1 if c.limit is None else c.limit + 1 - len(out)
            if room == 0:
                raise TooLarge("content is larger than allowed")
            part = z.decompress(rest, max(room, 0) if hasattr(z, "unconsumed_tail") else room)
            out += part
            rest = z.unconsumed_tail if hasattr(z, "unconsumed_tail") and not z.eof else b""
            if not part and not rest and not z.eof:
                if hasattr(z, "flush"):
                    out += z.flush()
                if not z.eof:
                    raise FormatError("input ends early")
        rest = z.unused_data.lstrip(b"\0") if several else b""
        if not rest:
            return bytes(out)


def _whole(data: bytes, wbits: int, c: Context, several: bool = False) -> bytes:
    return _streams(lambda: zlib.decompressobj(wbits), data, c, several)


def lzma1_filter(properties: bytes) -> dict:
    """From the five bytes of lc/lp/pb and dictionary size."""
    d, size = properties[0], struct.unpack("<I", properties[1:5])[0]
    if d >= 225:
        raise FormatError("no such properties")
    return {"id": lzma.FILTER_LZMA1, "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45, "dict_size": max(size, 4096)}


def _lzma_decode(data: bytes, c: Context) -> bytes:
    """With properties: a raw stream; without: the .lzma format."""
    if not c.properties:
        return _streams(lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE), data, c)
    z = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[lzma1_filter(c.properties)])
    most = [x for x in (c.size, None if c.limit is None else c.limit + 1) if x is not None]
    out = z.decompress(data, min(most, default=-1))
    if c.size is not None and len(out) < c.size:
        raise FormatError("input ends early")
    return out


LZMA_PROPERTIES = bytes([0x5D]) + struct.pack("<I", 1 << 23)


def _lzma_encode(data: bytes, c: Context) -> bytes:
    return lzma.compress(data, lzma.FORMAT_RAW, filters=[lzma1_filter(c.properties or LZMA_PROPERTIES)]) if c.properties else lzma.compress(data, lzma.FORMAT_ALONE)


def lzma2_size(byte: int) -> int:
    if byte > 40:
        raise FormatError("no such dictionary size")
    return 0xFFFFFFFF if byte == 40 else (2 | byte & 1) << (byte // 2 + 11)


def _lzma2_filter(c: Context) -> dict:
    return {"id": lzma.FILTER_LZMA2, "dict_size": min(max(4096, lzma2_size(c.properties[0])), 1536 << 20) if c.properties else 1 << 23}


def lzip_encode(data: bytes, c: Context) -> bytes:
    """Member: magic, version, dictionary byte, raw stream with an end mark, CRC, sizes."""
    bits = 23
    raw = lzma.compress(data, lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << bits}])[13:]
    return b"LZIP\x01" + bytes([bits]) + raw + struct.pack("<IQQ", zlib.crc32(data), len(data), len(raw) + 26)


def lzip_decode(data: bytes, c: Context = Context()) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        if data[at : at + 4] != b"LZIP" or data[at + 4] != 1:
            if at:
                break  # what follows the last member is no member
            raise FormatError("not an lzip stream")
        b = data[at + 5]
        size = (1 << (b & 31)) - ((1 << (b & 31)) // 16) * (b >> 5)
        z = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": max(4096, size)}])
        part = z.decompress(data[at + 6 :], -1 if c.limit is None else c.limit + 1 - len(out))
        if c.limit is not None and len(out) + len(part) > c.limit:
            raise TooLarge("content is larger than allowed")
        if not z.eof:
            raise FormatError("input ends early")
        end = len(data) - len(z.unused_data)
        crc, length, member = struct.unpack("<IQQ", data[end : end + 20])
        if zlib.crc32(part) != crc or len(part) != length or end + 20 - at != member:
            raise FormatError("member's trailer does not match")
        out += part
        at = end + 20
    return bytes(out)


def _zstd_decode(data: bytes, c: Context) -> bytes:
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(c.properties) if c.properties else None)
    if c.limit is not None:  # a reader makes no more than asked for
        with z.stream_reader(io.BytesIO(data), read_across_frames=True) as r:
            if len(r.read(c.limit + 1)) > c.limit:
                raise TooLarge("content is larger than allowed")
    out, rest = bytearray(), data
    while rest:
        d = z.decompressobj()
        out += d.decompress(rest)
        if not d.eof:
            raise FormatError("input ends early")
        rest = d.unused_data
    return bytes(out)


def _zstd_encode(data: bytes, c: Context) -> bytes:
    return zstandard.ZstdCompressor(level=3 if c.level is None else c.level, dict_data=zstandard.ZstdCompressionDict(c.properties) if c.properties else None, write_checksum=True).compress(data)


#: Order and memory of PPMd, as 7z keeps them.
PPMD_PROPERTIES = bytes([6]) + struct.pack("<I", 1 << 24)


def _ppmd(c: Context) -> tuple[int, int]:
    raw = c.properties or PPMD_PROPERTIES
    return raw[0], struct.unpack("<I", raw[1:5])[0]


def _ppmd_decode(data: bytes, c: Context) -> bytes:
    if c.size is None:
        raise UnsupportedCodec("ppmd needs the content's size")
    if c.limit is not None and c.size > c.limit:
        raise TooLarge("content is larger than allowed")
    return ppmd.decode(data, c.size, *_ppmd(c))


def _sized(name: str) -> Callable[[bytes, Context], bytes]:
    def run(data: bytes, c: Context) -> bytes:
        if c.size is None:
            raise UnsupportedCodec(f"{name} needs the content's size")
        return legacy.DECODERS[name](data, c.size)

    return run


def _free(name: str) -> Callable[[bytes, Context], bytes]:
    return lambda data, c: legacy.DECODERS[name](data, c.size)


def _reduce(k: int) -> Codec:
    return Codec(f"reduce{k}", lambda d, c: legacy.expand_reduced(d, c.size, k))


CODECS = (
    Codec("none", lambda d, c: d, lambda d, c: d),
    Codec("deflate", lambda d, c: _whole(d, -15, c), _raw_deflate, (0, 9)),
    Codec("zlib", lambda d, c: _whole(d, 15, c), lambda d, c: zlib.compress(d, 6 if c.level is None else c.level), (0, 9)),
    Codec("gzip", lambda d, c: _whole(d, 31, c, True), lambda d, c: gzip.compress(d, 6 if c.level is None else c.level, mtime=0), (0, 9)),
    Codec("bzip2", lambda d, c: _streams(bz2.BZ2Decompressor, d, c, True), lambda d, c: bz2.compress(d)),
    Codec("lzma", _lzma_decode, _lzma_encode),
    Codec("lzma2", lambda d, c: _streams(lambda: lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[_lzma2_filter(c)]), d, c), lambda d, c: lzma.compress(d, lzma.FORMAT_RAW, filters=[_lzma2_filter(c)])),
    Codec("lzip", lzip_decode, lzip_encode),
    Codec("xz", lambda d, c: _streams(lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), d, c, True)),
    Codec("ppmd", _ppmd_decode, lambda d, c: ppmd.encode(d, *_ppmd(c))),
    Codec("zstd", _zstd_decode, _zstd_encode, (1, 22)),
    *(Codec(n, _free(n)) for n in ("deflate64", "lzw", "rle90", "squeezed", "crunched", "adc")),
    *(Codec(n, _sized(n)) for n in ("shrink", "arj_lha", "arj_lh")),
    *map(_reduce, (1, 2, 3, 4)),
    Codec("implode", lambda d, c: legacy.explode(d, c.size, bool(c.flags & 2), bool(c.flags & 4))),
)


@dataclass(frozen=True)
class Registry:
    codecs: MappingProxyType[str, Codec] = field(default_factory=lambda: MappingProxyType({c.name: c for c in CODECS}))

    def with_codec(self, codec: Codec) -> Registry:
        return Registry(MappingProxyType({**self.codecs, codec.name: codec}))

    def get(self, name: str) -> Codec:
        if name not in self.codecs:
            raise UnsupportedCodec(f"no codec named {name}")
        return self.codecs[name]

    def __reduce__(self):
        return _registry, (dict(self.codecs),)


def _registry(codecs: dict[str, Codec]) -> Registry:
    return Registry(MappingProxyType(codecs))


DEFAULT, EMPTY = Registry(), Registry(MappingProxyType({}))


def compress(col: Column, codec: str, level: int | None = None, registry: Registry = DEFAULT) -> Column:
    """The column's bytes compressed; null for null."""
    check_level(registry.get(codec), level)
    names = None if registry is DEFAULT else registry

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        c = (names or DEFAULT).get(codec)
        return s.map(lambda x: None if x is None else c.compress(bytes(x), Context(level=level)))

    return run(col.cast("binary"))


def decompress(col: Column, codec: str, size: Column | None = None, on_error: str = "fail", registry: Registry = DEFAULT) -> Column:
    """The column's bytes decompressed; null for null, and for what can't be decoded if
    on_error is "null"."""
    names = None if registry is DEFAULT else registry
    registry.get(codec)

    @F.pandas_udf("binary")
    def run(s: pd.Series, n: pd.Series) -> pd.Series:
        c = (names or DEFAULT).get(codec)
        out = []
        for x, k in zip(s, n, strict=True):
            try:
                out.append(None if x is None else c.decompress(bytes(x), Context(size=None if k is None or k < 0 else int(k))))
            except ValueError:
                if on_error != "null":
                    raise
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(col, F.coalesce(size.cast("long"), F.lit(-1).cast("long")) if size is not None else F.lit(-1).cast("long"))


def zstd_frame_size(data: bytes) -> int | None:
    n = zstandard.frame_content_size(data)
    return None if n < 0 else n


def zstd_bound(n: int) -> int:
    """Largest size of a frame for n bytes, as the format's authors give it."""
    return n + (n >> 8) + ((131072 - n) >> 11 if n < 131072 else 0)
