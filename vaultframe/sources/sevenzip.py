"""The 7z container: its database of folders, streams and files, and a writer of one
folder per file."""

from __future__ import annotations

import io
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from vaultframe.functions import checksums, crypto, filters
from vaultframe.functions.codecs import DEFAULT, Context, Registry
from vaultframe.functions.times import EPOCH, file_time
from vaultframe.sources.model import ArchiveError, Damaged, Entry, Incomplete, Options, Unsupported

MAGIC = b"7z\xbc\xaf\x27\x1c"
#: Coder ids as the format's list assigns them: name, codec or filter.
CODERS = {
    b"\x00": ("None", "none"), b"\x21": ("LZMA2", "lzma2"), b"\x03\x01\x01": ("LZMA", "lzma"), b"\x04\x02\x02": ("BZip2", "bzip2"), b"\x04\x01\x08": ("Deflate", "deflate"), b"\x04\x01\x09": ("Deflate64", "deflate64"),
    b"\x04\xf7\x11\x01": ("ZStandard", "zstd"), b"\x03\x04\x01": ("PPMd", "ppmd"), b"\x03": ("Delta", "delta"), b"\x04": ("BCJ", "x86"), b"\x05": ("BCJ", "ppc"), b"\x06": ("BCJ", "ia64"), b"\x07": ("BCJ", "arm"), b"\x08": ("BCJ", "armt"), b"\x09": ("BCJ", "sparc"), b"\x0a": ("BCJ", "arm64"), b"\x0b": ("BCJ", "riscv"),
    b"\x03\x03\x01\x03": ("BCJ", "x86"), b"\x03\x03\x02\x05": ("BCJ", "ppc"), b"\x03\x03\x04\x01": ("BCJ", "ia64"), b"\x03\x03\x05\x01": ("BCJ", "arm"), b"\x03\x03\x07\x01": ("BCJ", "armt"), b"\x03\x03\x08\x05": ("BCJ", "sparc"), b"\x03\x03\x01\x1b": ("BCJ2", "bcj2"), b"\x06\xf1\x07\x01": ("AES", "aes"),
}


@dataclass
class Coder:
    id: bytes
    properties: bytes
    n_in: int
    n_out: int


@dataclass
class Folder:
    coders: list[Coder] = field(default_factory=list)
    binds: list[tuple[int, int]] = field(default_factory=list)
    packed: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    crc: int | None = None
    streams: int = 1
    first_pack: int = 0

    @property
    def main(self) -> int:
        bound = {o for _, o in self.binds}
        return next(i for i in range(len(self.sizes)) if i not in bound)


class Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def byte(self) -> int:
        if self.at >= len(self.raw):
            raise Damaged("7z header ends early")
        self.at += 1
        return self.raw[self.at - 1]

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise Damaged("7z header ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self) -> int:
        first, mask, value = self.byte(), 0x80, 0
        for i in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * i
            value |= self.byte() << 8 * i
            mask >>= 1
        return value

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[i // 8] & 128 >> i % 8) for i in range(n)]

    def some(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def digests(self, n: int) -> list[int | None]:
        return [struct.unpack("<I", self.take(4))[0] if x else None for x in self.some(n)]


def _streams(r: Reader) -> tuple[list[int], int, list[Folder], list[tuple[int, int | None]]]:
    """Pack sizes, position of the packs, folders, and (size, crc) of the substreams."""
    packs: list[int] = []
    start, folders, subs = 0, [], None
    while kind := r.number():
        if kind == 6:
            start, n = r.number(), r.number()
            while kind := r.number():
                if kind == 9:
                    packs = [r.number() for _ in range(n)]
                elif kind == 10:
                    r.digests(n)
        elif kind == 7:
            r.number()
            n = r.number()
            if r.byte():
                raise Unsupported("7z folders outside the header")
            folders = [_folder(r) for _ in range(n)]
            at = 0
            for f in folders:
                f.first_pack = at
                at += len(f.packed)
            while kind := r.number():
                if kind == 12:
                    for f in folders:
                        f.sizes = [r.number() for _ in range(sum(c.n_out for c in f.coders))]
                elif kind == 10:
                    for f, c in zip(folders, r.digests(n), strict=True):
                        f.crc = c
        elif kind == 8:
            subs = []
            kind = r.number()
            if kind == 13:
                for f in folders:
                    f.streams = r.number()
                kind = r.number()
            sizes = []
            for f in folders:
                own = [r.number() for _ in range(f.streams - 1)] if kind == 9 and f.streams else []
                sizes.append([*own, f.sizes[f.main] - sum(own)] if f.streams else [])
            if kind == 9:
                kind = r.number()
            open_ = [(i, j) for i, f in enumerate(folders) for j in range(f.streams) if not (f.streams == 1 and f.crc is not None)]
            found = {}
            while kind:
                if kind == 10:
                    found = dict(zip(open_, r.digests(len(open_)), strict=True))
                kind = r.number()
            for i, f in enumerate(folders):
                subs += [(s, found.get((i, j), f.crc if f.streams == 1 else None)) for j, s in enumerate(sizes[i])]
        else:
            raise Damaged(f"7z stream property {kind}")
    if subs is None:
        subs = [(f.sizes[f.main], f.crc) for f in folders]
    return packs, start, folders, subs


def _folder(r: Reader) -> Folder:
    f = Folder()
    for _ in range(r.number()):
        b = r.byte()
        ident = r.take(b & 15)
        n_in, n_out = (r.number(), r.number()) if b & 16 else (1, 1)
        f.coders.append(Coder(ident, r.take(r.number()) if b & 32 else b"", n_in, n_out))
    n_in, n_out = sum(c.n_in for c in f.coders), sum(c.n_out for c in f.coders)
    f.binds = [(r.number(), r.number()) for _ in range(n_out - 1)]
    free = n_in - (n_out - 1)
    bound = {i for i, _ in f.binds}
    f.packed = [next(i for i in range(n_in) if i not in bound)] if free == 1 else [r.number() for _ in range(free)]
    return f


def decode_folder(f: Folder, packs: list[bytes], registry: Registry, o: Options) -> bytes:
    def stream(out: int) -> bytes:
        at_in = at_out = 0
        for c in f.coders:
            if out < at_out + c.n_out:
                inputs = []
                for i in range(at_in, at_in + c.n_in):
                    bound = next((b for a, b in f.binds if a == i), None)
                    inputs.append(packs[f.packed.index(i)] if bound is None else stream(bound))
                return _run(c, inputs, f.sizes[at_out], registry, o)
            at_in, at_out = at_in + c.n_in, at_out + c.n_out
        raise Damaged("7z folder without such a stream")

    return stream(f.main)


def _run(c: Coder, inputs: list[bytes], size: int, registry: Registry, o: Options) -> bytes:
    if size > o.whole(sum(map(len, inputs))):
        raise Unsupported("content is larger than the limits allow")
    if c.id not in CODERS:
        raise Unsupported(f"7z coder {c.id.hex()}")
    name = CODERS[c.id][1]
    if name == "aes":
        if o.password is None:
            raise ArchiveError("a password is needed")
        b0, b1 = c.properties[0], c.properties[1] if len(c.properties) > 1 else 0
        n_salt, n_iv = (b0 >> 7) + (b1 >> 4), (b0 >> 6 & 1) + (b1 & 15)
        salt, iv = c.properties[2 : 2 + n_salt], c.properties[2 + n_salt : 2 + n_salt + n_iv]
        key = crypto.sevenzip_key(o.password, b0 & 63, salt)
        return crypto.aes_cbc_decrypt(key, iv.ljust(16, b"\0"), inputs[0])[:size]
    if name == "bcj2":
        return filters.bcj2(*inputs, size)
    if name == "delta":
        return filters.apply("delta", inputs[0], distance=c.properties[0] + 1)
    if name in filters.NAMES:
        return filters.apply(name, inputs[0])
    data = registry.get(name).decompress(inputs[0], Context(size, c.properties if name in ("lzma", "lzma2", "ppmd") else b"", limit=size))
    if len(data) < size:
        raise Incomplete("7z stream ends early")
    return data[:size]


def sevenzip_entries(data: bytes, o: Options, registry: Registry = DEFAULT) -> Iterator[Entry]:
    base = data.find(MAGIC, 0, 1 << 20) if o.look_for_header else 0
    if base < 0 or data[base : base + 6] != MAGIC or len(data) < base + 32:
        raise Damaged("not a 7z archive")
    where, size, crc = struct.unpack_from("<QQI", data, base + 12)
    if checksums.crc32(data[base + 12 : base + 32]) != struct.unpack_from("<I", data, base + 8)[0]:
        raise Damaged("7z start header's checksum does not match")
    if not size:
        return
    head = data[base + 32 + where : base + 32 + where + size]
    if len(head) < size:
        raise Incomplete("7z header is missing")
    if zlib.crc32(head) != crc:
        raise Damaged("7z header's checksum does not match")
    cut = lambda f, packs, start: [data[base + 32 + start + sum(packs[:i]) : base + 32 + start + sum(packs[: i + 1])] for i in range(f.first_pack, f.first_pack + len(f.packed))]
    while head[:1] == b"\x17":
        r = Reader(head)
        r.byte()
        packs, start, folders, _ = _streams(r)
        head = decode_folder(folders[0], cut(folders[0], packs, start), registry, o)
    r = Reader(head)
    if r.byte() != 1:
        raise Damaged("not a 7z header")
    packs, start, folders, subs = [], 0, [], []
    entries: list[Entry] = []
    empty: list[bool] = []
    while kind := r.number():
        if kind == 2:
            while r.number():
                r.take(r.number())
        elif kind == 4:
            packs, start, folders, subs = _streams(r)
        elif kind == 5:
            n = r.number()
            entries = [Entry("SevenZip", None, compressed_size=0, crc=0) for _ in range(n)]
            empty, plain, anti = [False] * n, [], []
            while kind := r.number():
                p = Reader(r.take(r.number()))
                if kind == 14:
                    empty = p.bits(n)
                elif kind == 15:
                    plain = p.bits(sum(empty))
                elif kind == 16:
                    anti = p.bits(sum(empty))
                elif kind == 17:
                    p.byte()
                    for e, name in zip(entries, p.raw[1:].decode("utf-16-le").split("\0"), strict=False):
                        e.key = name
                elif kind in (18, 19, 20):
                    have = p.some(n)
                    p.byte()
                    for e, x in zip(entries, have, strict=True):
                        when = file_time(struct.unpack("<Q", p.take(8))[0]) if x else None
                        if kind == 20:
                            e.last_modified = when
                elif kind == 21:
                    have = p.some(n)
                    p.byte()
                    for e, x in zip(entries, have, strict=True):
                        if x:
                            e.attrib = struct.unpack("<i", p.take(4))[0]
            i = 0
            for e, x in zip(entries, empty, strict=True):
                if x:
                    e.is_directory = not (i < len(plain) and plain[i])
                    if i < len(anti) and anti[i]:
                        e.format_meta["anti"] = "true"
                    i += 1
        else:
            raise Damaged(f"7z header property {kind}")
    slots = [(f, k, j) for k, f in enumerate(folders) for j in range(f.streams)]
    held: dict[int, bytes] = {}
    at = 0
    for e, x in zip(entries, empty or [False] * len(entries), strict=True):
        if x:
            e.size, e.read = 0, (lambda: b"")
            continue
        f, k, j = slots[at]
        size, crc = subs[at]
        e.folder, e.is_solid, e.size, e.crc = k, j > 0, size, crc or 0
        names = [CODERS.get(c.id, ("Unknown", ""))[0] for c in f.coders]
        e.compression_type = next((n for n in names if n not in ("BCJ", "BCJ2", "Delta", "AES")), "Unknown")
        e.is_encrypted = "AES" in names
        # A folder's packed streams serve all its entries; they count with the first.
        e.compressed_size = 0 if j else sum(packs[f.first_pack : f.first_pack + len(f.packed)])
        if e.is_encrypted:
            e.format_meta["encryption"] = "Aes256"
        e.check = checksums.crc32 if crc is not None else None
        offset = sum(s for s, _ in subs[at - j : at])

        def read(f: Folder = f, k: int = k, offset: int = offset, size: int = size) -> bytes:
            if k not in held:  # entries of a folder come in order: one decoding serves all
                held.clear()
                held[k] = decode_folder(f, cut(f, packs, start), registry, o)
            return held[k][offset : offset + size]

        e.read = read
        at += 1
    for e in entries:
        if e.key and e.is_directory and not e.key.endswith("/"):
            e.key += "/"
    yield from entries


def _number(n: int) -> bytes:
    for i in range(8):
        if n < 1 << (7 * (i + 1)):
            first = (0xFF00 >> i) & 0xFF | n >> 8 * i
            return bytes([first]) + (n & ((1 << 8 * i) - 1)).to_bytes(i, "little")
    return b"\xff" + n.to_bytes(8, "little")


def _bitmap(flags: list[bool]) -> bytes:
    out = bytearray((len(flags) + 7) // 8)
    for i, x in enumerate(flags):
        if x:
            out[i // 8] |= 128 >> i % 8
    return bytes(out)


def _packed_streams(packed: list[bytes], sizes: list[int], crcs: list[int], coder: bytes) -> bytes:
    n = len(packed)
    return b"\x06" + _number(0) + _number(n) + b"\x09" + b"".join(_number(len(p)) for p in packed) + b"\0" + b"\x07\x0b" + _number(n) + b"\0" + coder * n + b"\x0c" + b"".join(map(_number, sizes)) + b"\x0a\x01" + b"".join(struct.pack("<I", c) for c in crcs) + b"\0\0"


def write_sevenzip(rows: list[tuple[str, bytes | None, object]], method: str = "lzma", compressed_header: bool = False, dictionary: int = 1 << 20, fast_bytes: int = 32) -> bytes:
    """rows: key, content (None for a directory), modification time."""
    if method not in ("lzma", "lzma2"):
        raise Unsupported(f"7z is written with LZMA or LZMA2, not {method}")
    if not (1 << 12 <= dictionary <= 1 << 30 and 5 <= fast_bytes <= 273):
        raise ValueError(f"LZMA takes dictionaries of 4 KiB to 1 GiB and 5 to 273 fast bytes, not {dictionary} and {fast_bytes}")
    bits = dictionary.bit_length() - 1

    def pack(x: bytes) -> bytes:
        step = {"id": lzma.FILTER_LZMA1 if method == "lzma" else lzma.FILTER_LZMA2, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << bits, "nice_len": fast_bytes}
        return lzma.compress(x, lzma.FORMAT_RAW, filters=[step])

    coder = b"\x01\x23\x03\x01\x01\x05\x5d" + struct.pack("<I", 1 << bits) if method == "lzma" else b"\x01\x21\x21\x01" + bytes([(bits - 12) * 2])
    full = [x for _, x, _ in rows if x]
    packed = [pack(x) for x in full]
    head = io.BytesIO()
    head.write(b"\x01")
    if full:
        head.write(b"\x04" + _packed_streams(packed, [len(x) for x in full], [zlib.crc32(x) for x in full], coder))
    head.write(b"\x05" + _number(len(rows)))
    empty = [not x for _, x, _ in rows]

    def put(kind: int, raw: bytes) -> None:
        head.write(bytes([kind]) + _number(len(raw)) + raw)

    if any(empty):
        put(14, _bitmap(empty))
        files = [x is not None for _, x, _ in rows if not x]
        if any(files):
            put(15, _bitmap(files))
    put(17, b"\0" + b"".join(k.rstrip("/").encode("utf-16-le") + b"\0\0" for k, _, _ in rows))
    if any(t for _, _, t in rows):
        have = [t is not None for _, _, t in rows]
        when = b"".join(struct.pack("<Q", int((t - EPOCH).total_seconds() * 10_000_000) + 116444736000000000) for _, _, t in rows if t is not None)
        put(20, (b"\x01" if all(have) else b"\0" + _bitmap(have)) + b"\0" + when)
    head.write(b"\0\0")
    raw, body = head.getvalue(), b"".join(packed)
    if compressed_header and rows:
        small = pack(raw)
        streams = b"\x17" + _packed_streams([small], [len(raw)], [zlib.crc32(raw)], coder)
        streams = streams.replace(b"\x17\x06\x00", b"\x17\x06" + _number(len(body)), 1)
        raw, body = streams, body + small
    start = struct.pack("<QQI", len(body), len(raw) if rows else 0, zlib.crc32(raw) if rows else 0)
    return MAGIC + b"\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + (raw if rows else b"")
