"""Archives and streams in formats that the engine reads but never writes, made plainly
for the queries: literal codes, stored entries, and what the standard library packs."""

from __future__ import annotations

import heapq
import io
import lzma
import struct
import zlib
from collections import Counter

import numpy as np
import zstandard

from vaultframe.functions import checksums, crypto, filters
from vaultframe.functions.codecs import DEFAULT, PPMD_PROPERTIES
from vaultframe.sources import sevenzip
from vaultframe.sources.writers import Item, WriteOptions, write_tar

PASSWORD = "open sesame"
#: 2021-03-04 05:06:08 as DOS has it.
WHEN = 0x526428C4


# Streams


def _low_bits(values: np.ndarray, width: int) -> bytes:
    """Codes of one width, lowest bit first."""
    return np.packbits((values[:, None] >> np.arange(width)) & 1, bitorder="little").tobytes()


def lzw(data: bytes, most: int = 16, start: bytes | None = None) -> bytes:
    """A .Z stream: codes of growing width in groups of eight."""
    table, width, following, now, group = {bytes([i]): i for i in range(256)}, 9, 257, b"", []
    out = bytearray(b"\x1f\x9d" + bytes([most | 128]) if start is None else start)

    def flush(full: bool) -> None:
        if group:
            value = sum(c << i * width for i, c in enumerate(group))
            out.extend(value.to_bytes(width if full else (len(group) * width + 7) // 8, "little"))
            group.clear()

    for b in data:
        x = now + bytes([b])
        if x in table:
            now = x
            continue
        group.append(table[now])
        if len(group) == 8:
            flush(True)
        if following < 1 << most:
            table[x] = following
            following += 1
            if following > 1 << width and width < most:
                flush(True)
                width += 1
        now = bytes([b])
    if now:
        group.append(table[now])
    flush(False)
    return bytes(out)


def escaped(data: bytes) -> bytes:
    """RLE90 without runs, and Reduce's literals: 0x90 is followed by a zero."""
    return data.replace(b"\x90", b"\x90\0")


def rle90(data: bytes) -> bytes:
    """Runs of four and more as a byte, 0x90 and how many."""
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 255 and data[i : i + 1] == data[i + n : i + n + 1]:
            n += 1
        if n > 3 and data[i] != 0x90:
            out += bytes([data[i], 0x90, n])
            i += n
        else:
            out += escaped(data[i : i + 1])
            i += 1
    return bytes(out)


def squeezed(data: bytes) -> bytes:
    """Huffman codes over bytes and an end (256), as a list of nodes."""
    text = [*escaped(data), 256]
    heap = [(n, i, i) for i, n in Counter(text).items()] + [(0, 300 + i, 256) for i in range(1 if len(set(text)) == 1 else 0)]
    heapq.heapify(heap)
    nodes: list[tuple] = []
    while len(heap) > 1:
        (a, _, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
        nodes.append((x, y))
        heapq.heappush(heap, (a + b, 1000 + len(nodes), ("node", len(nodes) - 1)))
    order = list(range(len(nodes)))[::-1]  # the root comes first
    place = {k: i for i, k in enumerate(order)}
    child = lambda c: place[c[1]] if isinstance(c, tuple) else -(c + 1)
    out = bytearray(struct.pack("<H", len(nodes)))
    codes: dict[int, str] = {}
    todo: list[tuple] = [(("node", len(nodes) - 1), "")]
    while todo:
        c, code = todo.pop()
        if isinstance(c, tuple):
            todo += [(nodes[c[1]][k], code + str(k)) for k in (0, 1)]
        else:
            codes.setdefault(c, code)
    for k in order:
        out += struct.pack("<hh", *map(child, nodes[k]))
    bits = "".join(codes[s] for s in text)
    return bytes(out) + np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48, bitorder="little").tobytes()


def crunched(data: bytes) -> bytes:
    return lzw(escaped(data), 12, b"\x0c")


def shrunk(data: bytes) -> bytes:
    """Literals alone, each a code of nine bits."""
    return _low_bits(np.frombuffer(data, np.uint8).astype(np.int64), 9) if data else b""


def reduced(data: bytes) -> bytes:
    """No byte has followers, so all are literals."""
    return bytes(192) + escaped(data)


def imploded(data: bytes) -> bytes:
    """Trees of equal lengths, then literals: a one and eight bits."""
    trees = bytes([3, 0xF5, 0xF5, 0xF5, 0xF5]) * 2
    return trees + (_low_bits(np.frombuffer(data, np.uint8).astype(np.int64) << 1 | 1, 9) if data else b"")


def adc(data: bytes) -> bytes:
    return b"".join(bytes([127 + len(part)]) + part for part in (data[i : i + 128] for i in range(0, len(data), 128)))


def arj_fastest(data: bytes) -> bytes:
    """ARJ's method 4, literals alone: a zero and eight bits, highest first."""
    x = np.frombuffer(data, np.uint8)[:, None] >> np.arange(8, -1, -1).clip(max=7)
    x = x & 1
    x[:, 0] = 0
    return np.packbits(x).tobytes() if data else b""


def arj_best(data: bytes) -> bytes:
    """ARJ's methods 1 to 3: blocks of literals in codes of eight bits for all bytes."""
    bits: list[str] = []
    put = lambda v, n: bits.append(format(v, f"0{n}b"))
    for i in range(0, len(data), 30_000):
        part = data[i : i + 30_000]
        put(len(part), 16)
        put(0, 5), put(10, 5)  # all main codes have length 10 - 2
        put(256, 9)
        put(0, 5), put(0, 5)
        bits.append("".join(format(b, "08b") for b in part))
    text = "".join(bits)
    return np.packbits(np.frombuffer(text.encode(), np.uint8) - 48).tobytes() if text else b""


def deflate64(data: bytes) -> bytes:
    """Without copies deflate's stream is deflate64's too."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return z.compress(data) + z.flush()


def xz(data: bytes) -> bytes:
    return lzma.compress(data, lzma.FORMAT_XZ, check=lzma.CHECK_CRC64)


def zstd(data: bytes) -> bytes:
    return zstandard.ZstdCompressor().compress(data)


STREAMS = {
    "lzw": lzw, "rle90": rle90, "squeezed": squeezed, "crunched": crunched, "shrink": shrunk, "reduce1": reduced, "reduce2": reduced, "reduce3": reduced, "reduce4": reduced,
    "implode": imploded, "adc": adc, "arj_lh": arj_fastest, "arj_lha": arj_best, "deflate64": deflate64, "xz": xz,
}


# Archives


def tar_of(pack) -> object:
    return lambda items: pack(write_tar(items, WriteOptions()))


def _pax(items: list[Item]) -> bytes:
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for x in items:
            m = tarfile.TarInfo(x.key)
            m.size, m.pax_headers = len(x.content), {"comment": "made", "mtime": "1614834368.25"}
            t.addfile(m, io.BytesIO(x.content))
    return out.getvalue()


def _zip(items: list[Item], method: int, flags: int, extra: bytes, pack) -> bytes:
    out, central = bytearray(), bytearray()
    for x in items:
        body, name, crc = pack(x.content), x.key.encode(), zlib.crc32(x.content)
        crc = 0 if method == 99 else crc
        fields = struct.pack("<HHHIIIIHH", 20, flags, method, WHEN, crc, len(body), len(x.content), len(name), len(extra))
        central += b"PK\x01\x02" + struct.pack("<H", 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, len(out)) + name + extra
        out += b"PK\x03\x04" + fields + name + extra + body
    return bytes(out + central) + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(items), len(items), len(central), len(out), 0)


def zip_by(codec: str, method: int, flags: int = 0):
    return lambda items: _zip(items, method, flags, b"", STREAMS[codec])


def _deflated(data: bytes) -> bytes:
    return zlib.compress(data, wbits=-15)


def zip_pkware(items: list[Item]) -> bytes:
    return _zip(items, 8, 1, b"", lambda x: crypto.zipcrypto(bytes(11) + bytes([zlib.crc32(x) >> 24]) + _deflated(x), PASSWORD.encode(), encrypt=True))


def zip_aes(items: list[Item]) -> bytes:
    return _zip(items, 99, 1, struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", 3, 8), lambda x: crypto.winzip_encrypt(_deflated(x), PASSWORD.encode(), 3, bytes(range(16))))


_LZMA2 = b"\x21\x21\x01\x10"


def _lzma2(data: bytes) -> bytes:
    return lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])


def sevenzip_by(coder: bytes, pack, chain: bytes = b"", sized=len):
    """7z with all entries in one folder. chain: coders after the one that packs, each
    bound to the one before, as the header lists them (the last first)."""

    def make(items: list[Item]) -> bytes:
        n = sevenzip._number
        full = [x for x in items if x.content]
        whole = b"".join(x.content for x in full)
        body = pack(whole)
        two = bool(chain)
        folder = (n(2) + chain + coder + n(0) + n(1)) if two else n(1) + coder
        head = b"\x01\x04\x06" + n(0) + n(1) + b"\x09" + n(len(body)) + b"\0" + b"\x07\x0b" + n(1) + b"\0" + folder
        head += b"\x0c" + n(len(whole)) + (n(sized(whole)) if two else b"") + b"\0"
        head += b"\x08\x0d" + n(len(full)) + b"\x09" + b"".join(n(len(x.content)) for x in full[:-1]) + b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(x.content)) for x in full) + b"\0\0"
        names = b"\0" + "".join(x.key + "\0" for x in items).encode("utf-16-le")
        empty = [not x.content for x in items]
        head += b"\x05" + n(len(items))
        if any(empty):
            bits = sevenzip._bitmap(empty)
            files = sevenzip._bitmap([True] * sum(empty))
            head += b"\x0e" + n(len(bits)) + bits + b"\x0f" + n(len(files)) + files
        head += b"\x11" + n(len(names)) + names + b"\0\0"
        start = struct.pack("<QQI", len(body), len(head), zlib.crc32(head))
        return sevenzip.MAGIC + b"\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + head

    return make


def _aes(data: bytes) -> bytes:
    key = crypto.sevenzip_key(PASSWORD, 6, b"")
    return crypto.aes_cbc_encrypt(key, bytes(16), data + bytes(-len(data) % 16))


SEVENZIP = {
    "solid": sevenzip_by(_LZMA2, _lzma2),
    "copy": sevenzip_by(b"\x01\0", lambda x: x),
    "deflate": sevenzip_by(b"\x03\x04\x01\x08", _deflated),
    "bzip2": sevenzip_by(b"\x03\x04\x02\x02", lambda x: __import__("bz2").compress(x)),
    "zstd": sevenzip_by(b"\x04\x04\xf7\x11\x01", lambda x: zstandard.ZstdCompressor().compress(x)),
    "delta": sevenzip_by(_LZMA2, lambda x: _lzma2(filters.apply("delta", x, True, distance=4)), b"\x21\x03\x01\x03"),
    "x86": sevenzip_by(_LZMA2, lambda x: _lzma2(filters.apply("x86", x, True)), b"\x04\x03\x03\x01\x03"),
    "riscv": sevenzip_by(_LZMA2, lambda x: _lzma2(filters.apply("riscv", x, True)), b"\x01\x0b"),
    "aes": sevenzip_by(b"\x24\x06\xf1\x07\x01\x01\x06", lambda x: _aes(_lzma2(x)), b"\x21\x21\x01\x10", lambda x: len(_lzma2(x))),
}


ppmd = sevenzip_by(b"\x23\x03\x04\x01\x05" + PPMD_PROPERTIES, lambda x: DEFAULT.get("ppmd").compress(x))


def arc(method: int, pack=lambda x: x):
    def make(items: list[Item]) -> bytes:
        out = bytearray()
        for x in items:
            body = pack(x.content)
            out += bytes([0x1A, method]) + x.key.encode()[-12:].ljust(13, b"\0") + struct.pack("<IHHHI", len(body), WHEN >> 16, WHEN & 0xFFFF, checksums.crc16_arc(x.content), len(x.content)) + body
        return bytes(out) + b"\x1a\0"

    return make


def arj(method: int, pack=lambda x: x):
    def header(kind: int, name: bytes, body: bytes, content: bytes) -> bytes:
        head = bytes([30, 11, 1, 0, 0, method, kind, 0]) + struct.pack("<IIIIHHH", WHEN, len(body), len(content), zlib.crc32(content), 0, 0, 0) + name + b"\0\0"
        return b"\x60\xea" + struct.pack("<H", len(head)) + head + struct.pack("<I", zlib.crc32(head)) + b"\0\0" + body

    return lambda items: header(2, b"made.arj", b"", b"") + b"".join(header(0, x.key.encode(), pack(x.content), x.content) for x in items) + b"\x60\xea\0\0"


def ace(items: list[Item]) -> bytes:
    def block(head: bytes) -> bytes:
        return struct.pack("<HH", checksums.ace_header_crc(head), len(head)) + head

    out = block(b"\0\0\0**ACE**" + bytes(20))
    for x in items:
        name = x.key.encode()
        out += block(b"\x01\x01\0" + struct.pack("<IIIII", len(x.content), len(x.content), WHEN, 0, checksums.crc32_raw(x.content)) + b"\0\x03\0\0\0\0" + struct.pack("<H", len(name)) + name) + x.content
    return out


def rar4(password: str | None = None):
    def block(head: bytes) -> bytes:
        return struct.pack("<H", zlib.crc32(head) & 0xFFFF) + head

    def make(items: list[Item]) -> bytes:
        out, salt = b"Rar!\x1a\x07\0" + block(struct.pack("<BHH6x", 0x73, 0, 13)), b"saltsalt" if password else b""
        for x in items:
            name, body = x.key.encode(), x.content
            if password:
                body = crypto.aes_cbc_encrypt(*crypto.rar3_key(password, salt), body + bytes(-len(body) % 16))
            flags = 0x8404 if password else 0x8000
            out += block(struct.pack("<BHHIIBIIBBHI", 0x74, flags, 32 + len(name) + len(salt), len(body), len(x.content), 2, zlib.crc32(x.content), WHEN, 29, 0x30, len(name), 32) + name + salt) + body
        return out

    return make


def _vint(n: int) -> bytes:
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + _vint(n >> 7)


def _rar5_block(data: bytes) -> bytes:
    """Literals in codes of nine bits, behind tables of equal lengths."""
    bits = ["0101" * 20, *(format(size, "05b") * n for n, size in ((306, 9), (64, 6), (16, 4), (44, 6))), *(format(b, "09b") for b in data)]
    text = "".join(bits)
    raw = np.packbits(np.frombuffer(text.encode(), np.uint8) - 48).tobytes()
    size = len(raw).to_bytes(3, "little")
    flags = (len(text) - 1) % 8 | 2 << 3 | 0xC0
    return bytes([flags, 0x5A ^ flags ^ size[0] ^ size[1] ^ size[2]]) + size + raw


def rar5(method: int, password: str | None = None):
    def block(head: bytes) -> bytes:
        x = _vint(len(head)) + head
        return struct.pack("<I", zlib.crc32(x)) + x

    def make(items: list[Item]) -> bytes:
        out = bytearray(b"Rar!\x1a\x07\x01\0" + block(b"\x01\0\0"))
        for x in items:
            body, extra, name = _rar5_block(x.content) if method and x.content else x.content, b"", x.key.encode()
            if password:
                salt, iv = bytes(range(16)), bytes(range(16, 32))
                body = crypto.aes_cbc_encrypt(crypto.rar5_key(password, salt, 4), iv, body + bytes(-len(body) % 16))
                extra = bytes([1, 0, 1, 4]) + salt + iv + crypto.rar5_check(password, salt, 4) + bytes(4)
                extra = bytes([len(extra)]) + extra
            fields = (_vint(len(extra)) if extra else b"") + _vint(len(body)) + b"\x04" + _vint(len(x.content)) + b"\0" + struct.pack("<I", zlib.crc32(x.content)) + _vint(method << 7 if x.content else 0) + b"\0" + _vint(len(name)) + name + extra
            out += block(bytes([2, 3 if extra else 2]) + fields) + body
        return bytes(out) + block(b"\x05\0\0")

    return make
