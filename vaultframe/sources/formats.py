"""Readers of each archive format: bytes of an archive to its entries, contents lazily."""

from __future__ import annotations

import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

from vaultframe.functions import checksums, crypto, rar5
from vaultframe.functions.codecs import DEFAULT, Context, Registry
from vaultframe.functions.times import dos_time, file_time, unix_time
from vaultframe.sources.model import ArchiveError, Damaged, Entry, Incomplete, Options, Unsupported

#: Zip method numbers, as the format's note assigns them: name of the method, codec.
ZIP_METHODS = {
    0: ("None", "none"), 1: ("Shrink", "shrink"), 2: ("Reduce1", "reduce1"), 3: ("Reduce2", "reduce2"), 4: ("Reduce3", "reduce3"), 5: ("Reduce4", "reduce4"),
    6: ("Explode", "implode"), 8: ("Deflate", "deflate"), 9: ("Deflate64", "deflate64"), 12: ("BZip2", "bzip2"), 14: ("LZMA", "lzma"), 93: ("ZStandard", "zstd"), 95: ("Xz", "xz"), 98: ("PPMd", "ppmd"),
}


def _extras(raw: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(raw):
        kind, n = struct.unpack_from("<HH", raw, at)
        out.setdefault(kind, raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _zip_name(raw: bytes, flags: int, extras: dict[int, bytes], o: Options) -> str:
    if o.force_encoding:
        return raw.decode(o.encoding, "replace")
    x = extras.get(0x7075)
    if x and x[0] == 1 and struct.unpack_from("<I", x, 1)[0] == zlib.crc32(raw):
        return x[5:].decode("utf-8", "replace")
    return raw.decode("utf-8" if flags & 0x800 else o.encoding, "replace")


def _zip_entry(data: bytes, registry: Registry, o: Options, flags: int, method: int, time: int, crc: int, packed: int, size: int, name: bytes, extras: dict[int, bytes], body: int, comment: str = "", attrib: int | None = None) -> Entry:
    aes = extras.get(0x9901) if method == 99 else None
    strength, version = 0, 0
    if aes:
        version, strength, method = struct.unpack_from("<H", aes)[0], aes[4], struct.unpack_from("<H", aes, 5)[0]
    label, codec = ZIP_METHODS.get(method, ("Unknown", ""))
    key = _zip_name(name, flags, extras, o)
    e = Entry("Zip", key, label, size, packed, crc, dos_time(time), is_directory=key.endswith("/") or bool(attrib and attrib & 16 and not size), is_encrypted=bool(flags & 1), attrib=None if attrib is None else attrib - (attrib >> 31 << 32))
    x = extras.get(0x5455)
    if x:
        at, when = 1, {}
        for bit, field in ((1, "last_modified"), (2, "last_accessed"), (4, "created")):
            if x[0] & bit and at + 4 <= len(x):
                when[field] = unix_time(struct.unpack_from("<i", x, at)[0])
                at += 4
        e.last_accessed, e.created = when.get("last_accessed"), when.get("created")
        e.last_modified = when.get("last_modified", e.last_modified)
    x = extras.get(0x0A)
    if x and len(x) >= 32 and struct.unpack_from("<HH", x, 4) == (1, 24):  # NTFS times
        e.last_modified, e.last_accessed, e.created = (file_time(n) for n in struct.unpack_from("<QQQ", x, 8))
    if comment:
        e.format_meta["comment"] = comment
    if flags & 1:
        e.format_meta["encryption"] = f"WinZipAes{64 + 64 * strength}" if aes else "PkwareTraditional"
    e.check = None if e.is_directory or (aes and version == 2) else checksums.crc32

    def read() -> bytes:
        raw = data[body : body + e.compressed_size]
        if len(raw) < e.compressed_size:
            raise Incomplete("archive ends within an entry")
        if flags & 1:
            if o.password is None:
                raise ArchiveError("a password is needed")
            if aes:
                raw = crypto.winzip_decrypt(raw, o.password.encode(), strength)
            elif codec == "lzma":
                raise Unsupported("LZMA under the traditional cipher")
            else:
                raw = crypto.zipcrypto(raw, o.password.encode(), (time >> 8 & 255) if flags & 8 else crc >> 24)
        if not codec or codec == "ppmd":  # zip's PPMd is another variant than 7z's
            raise Unsupported(f"zip method {method}")
        _guard(e.size, len(raw), o)
        most = o.limit(len(raw)) if e.size is None else e.size
        if codec == "lzma":
            n = struct.unpack_from("<H", raw, 2)[0]
            return registry.get("lzma").decompress(raw[4 + n :], Context(e.size, raw[4 : 4 + n], limit=most))
        return registry.get(codec).decompress(raw, Context(e.size, flags=flags, limit=most))

    e.read = read
    return e


def _guard(size: int | None, packed: int, o: Options) -> None:
    if size is not None and (size > o.max_entry_bytes or size > o.max_ratio * max(packed, 1)):
        raise Unsupported("content is larger than the limits allow")


def zip_entries(data: bytes, o: Options, registry: Registry = DEFAULT) -> Iterator[Entry]:
    """By the central directory, or by local headers alone."""
    if o.streaming:
        yield from _zip_stream(data, o, registry)
        return
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65557 - 4096))
    if end < 0:
        raise Damaged("no end of central directory")
    count, size, start = struct.unpack_from("<HII", data, end + 10)
    disk = struct.unpack_from("<H", data, end + 6)[0]
    # Of a set of volumes offsets count from their own one's start, of plain cuts from the first's.
    bases = [sum(o.volumes[:i]) for i in range(len(o.volumes))] if disk and len(o.volumes) > 1 else []
    if bases and disk >= len(bases):
        raise Incomplete("a volume is missing")
    shift = 0 if bases else end - size - start
    start += bases[disk] if bases else 0
    locator = data.rfind(b"PK\x06\x07", max(0, end - 20), end)
    if locator >= 0:
        at = struct.unpack_from("<Q", data, locator + 8)[0]
        if data[at : at + 4] != b"PK\x06\x06":
            at = data.rfind(b"PK\x06\x06", 0, locator)
        count, size, start = struct.unpack_from("<QQQ", data, at + 32)
        shift = at - size - start
    at = start + shift
    finish = at + size
    note = data[end + 22 : end + 22 + struct.unpack_from("<H", data, end + 20)[0]].decode("utf-8", "replace")
    i = 0
    # Writers that know no zip64 count to 65535 or start again there: the size then tells.
    while i < count or at < finish and data[at : at + 4] == b"PK\x01\x02":
        if data[at : at + 4] != b"PK\x01\x02":
            raise Damaged("no central header where one should be")
        flags, method, time, crc, packed, full, n, m, k = struct.unpack_from("<HHIIIIHHH", data, at + 8)
        attrib, local = struct.unpack_from("<II", data, at + 38)
        disk = struct.unpack_from("<H", data, at + 34)[0]
        name, extras = data[at + 46 : at + 46 + n], _extras(data[at + 46 + n : at + 46 + n + m])
        x, j = extras.get(1, b""), 0
        if full == 0xFFFFFFFF and len(x) >= j + 8:
            full, j = struct.unpack_from("<Q", x, j)[0], j + 8
        if packed == 0xFFFFFFFF and len(x) >= j + 8:
            packed, j = struct.unpack_from("<Q", x, j)[0], j + 8
        if local == 0xFFFFFFFF and len(x) >= j + 8:
            local = struct.unpack_from("<Q", x, j)[0]
        if bases and disk >= len(bases):
            raise Incomplete("a volume is missing")
        local += bases[disk] if bases else shift
        a, b = struct.unpack_from("<HH", data, local + 26)
        comment = data[at + 46 + n + m : at + 46 + n + m + k].decode("utf-8" if flags & 0x800 else o.encoding, "replace")
        e = _zip_entry(data, registry, o, flags, method, time, crc, packed, full, name, extras, local + 30 + a + b, comment, attrib)
        if bases:
            e.volume_index_first = disk
            e.volume_index_last = sum(local + 30 + a + b + packed > x for x in bases[1:])
        if note and not i:
            e.format_meta["archive_comment"] = note
        e.format_meta["format_version"] = str(data[at + 6])
        yield e
        i, at = i + 1, at + 46 + n + m + k


def zip_comment(data: bytes, encoding: str = "utf-8") -> str | None:
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65557))
    return data[end + 22 :].decode(encoding, "replace") or None if end >= 0 else None


def _zip_stream(data: bytes, o: Options, registry: Registry) -> Iterator[Entry]:
    at = data.find(b"PK\x03\x04") if o.look_for_header else 0
    if data[:4] == b"PK00":
        at = 4
    while data[at : at + 4] == b"PK\x03\x04":
        flags, method, time, crc, packed, full, n, m = struct.unpack_from("<HHIIIIHH", data, at + 6)
        name, extras, body = data[at + 30 : at + 30 + n], _extras(data[at + 30 + n : at + 30 + n + m]), at + 30 + n + m
        x = extras.get(1, b"")
        if full == 0xFFFFFFFF and packed == 0xFFFFFFFF and len(x) >= 16:
            full, packed = struct.unpack_from("<QQ", x)
        deferred = bool(flags & 8) and not packed
        if deferred:  # the content itself tells where it ends, or the descriptor does
            packed, full, crc, after = _descriptor(data, body, method, flags, 1 in extras)
        else:
            after = body + packed
            if flags & 8:
                after += 4 if data[after : after + 4] == b"PK\x07\x08" else 0
                after += 20 if 1 in extras else 12
        e = _zip_entry(data, registry, o, flags, method, time, crc, packed, full, name, extras, body)
        if deferred:
            e.format_meta["deferred_size"] = "true"
        yield e
        at = after


def _descriptor(data: bytes, body: int, method: int, flags: int, wide: bool) -> tuple[int, int, int, int]:
    packed = None
    if method == 8 and not flags & 1:
        z = zlib.decompressobj(-15)
        z.decompress(data[body:])
        packed = len(data) - body - len(z.unused_data)
    at = body if packed is None else body + packed
    while True:
        at = data.find(b"PK\x07\x08", at) if packed is None else at
        if at < 0:
            raise Incomplete("no data descriptor")
        mark = 4 if data[at : at + 4] == b"PK\x07\x08" else 0
        for form in ("<IQQ", "<III") if wide else ("<III", "<IQQ"):
            if at + mark + struct.calcsize(form) <= len(data):
                crc, n, full = struct.unpack_from(form, data, at + mark)
                if n == at - body:
                    return n, full, crc, at + mark + struct.calcsize(form)
        if packed is not None:
            raise Damaged("data descriptor does not match")
        at += 4


class File(io.RawIOBase):
    """A file over bytes, or over a mapped file, of which only what is read is touched."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, at: int, whence: int = 0) -> int:
        self.at = at + (0, self.at, len(self.data))[whence]
        return self.at

    def readinto(self, to) -> int:
        part = self.data[self.at : self.at + len(to)]
        to[: len(part)] = part
        self.at += len(part)
        return len(part)


_TAR_KIND = {b"0": "File", b"\0": "OldFile", b"1": "HardLink", b"2": "SymLink", b"3": "CharDevice", b"4": "BlockDevice", b"5": "Directory", b"6": "Fifo", b"7": "File", b"S": "SparseFile"}


def tar_entries(data: bytes, o: Options, registry: Registry = DEFAULT, outer: str = "None") -> Iterator[Entry]:
    try:
        with tarfile.open(fileobj=File(data), mode="r:", encoding="utf-8", errors="replace") as tar:
            for m in tar:
                link = m.linkname if m.issym() or m.islnk() else None
                e = Entry("Tar", m.name + ("/" if m.isdir() else ""), outer, m.size, m.size, 0, unix_time(m.mtime), link_target=link, is_directory=m.isdir(), outer_compression=outer)
                e.format_meta |= {"mode": str(m.mode), "uid": str(m.uid), "gid": str(m.gid), "kind": _TAR_KIND.get(m.type, "Other")}
                start, size = m.offset_data, m.size

                def read(start: int = start, size: int = size) -> bytes:
                    _guard(size, size, o)
                    if start + size > len(data):
                        raise Incomplete("archive ends within an entry")
                    return data[start : start + size]

                e.read = read if m.isreg() else (lambda: b"")
                yield e
    except tarfile.TarError as x:
        raise Damaged(f"tar: {x}") from x


def gzip_entries(data: bytes, o: Options, registry: Registry = DEFAULT) -> Iterator[Entry]:
    if data[:2] != b"\x1f\x8b" or len(data) < 18:
        raise Damaged("not a gzip stream")
    flags, mtime, at, name = data[3], struct.unpack_from("<I", data, 4)[0], 10, None
    if flags & 4:
        at += 2 + struct.unpack_from("<H", data, at)[0]
    if flags & 8:
        end = data.index(b"\0", at)
        name = data[at:end].decode("latin-1")
    crc, size = struct.unpack_from("<II", data, len(data) - 8)
    several = data.find(b"\x1f\x8b\x08", 18) >= 0 and _members(data) > 1
    e = Entry("GZip", name, "GZip", None if several else size, 0, None if several else crc, unix_time(mtime) if mtime else None, check=None if several else checksums.crc32)
    if several:  # each has a size and a checksum of its own, which decoding compares
        e.format_meta["members"] = "several"
    e.read = lambda: registry.get("gzip").decompress(data, Context(limit=o.limit(len(data))))
    yield e


def _members(data: bytes) -> int:
    """Gzip members, two at most; what they become isn't kept."""
    z, at = zlib.decompressobj(31), 0
    while not z.eof and at < len(data):
        part, at = data[at : at + 65536], at + 65536
        while part and not z.eof:
            z.decompress(part, 1 << 20)
            part = z.unconsumed_tail
    rest = (z.unused_data + data[at : at + 3])[:3]
    return 2 if rest == b"\x1f\x8b\x08" else 1


def lzw_entries(data: bytes, o: Options, registry: Registry = DEFAULT) -> Iterator[Entry]:
    if data[:2] != b"\x1f\x9d":
        raise Damaged("not a .Z stream")
    yield Entry("Lzw", None, "Lzw", 0, 0, 0, read=lambda: registry.get("lzw").decompress(data, Context(limit=o.limit(len(data)))))


def arc_entries(data: bytes, o: Options, registry: Registry = DEFAULT) -> Iterator[Entry]:
    #: Method numbers and what they are called.
    methods = {1: "None", 2: "None", 3: "Packed", 4: "Squeezed", 5: "Crunched", 6: "Crunched", 7: "Crunched", 8: "Crunched", 9: "Squashed", 10: "Crushed", 11: "Distilled"}
    at = 0
    while at + 2 <= len(data) and data[at] == 0x1A and data[at + 1]:
        method = data[at + 1]
        n = 25 if method == 1 else 29
        if at + n > len(data):
            raise Incomplete("archive ends within a header")
        name = data[at + 2 : at + 15].split(b"\0")[0].decode(o.encoding, "replace")
        packed, date, time, crc = struct.unpack_from("<IHHH", data, at + 15)
        full = packed if method == 1 else struct.unpack_from("<I", data, at + 25)[0]
        body = at + n
        codec = {1: "none", 2: "none", 3: "rle90", 4: "squeezed", 8: "crunched"}.get(method)
        e = Entry("Arc", name, methods.get(method, "Unknown"), None, packed, crc, check=checksums.crc16_arc if codec else None)
        e.format_meta |= {"original_size": str(full), "header_time": str(dos_time(date << 16 | time))}

        def read(codec: str | None = codec, body: int = body, packed: int = packed, full: int = full, method: int = method) -> bytes:
            if codec is None or (codec == "crunched" and full > 131072):
                raise Unsupported(f"arc method {method}")
            if body + packed > len(data):
                raise Incomplete("archive ends within an entry")
            return registry.get(codec).decompress(data[body : body + packed], Context(full, limit=min(full, o.limit(packed))))

        e.read = read
        yield e
        at = body + packed


def arj_entries(data: bytes, o: Options, registry: Registry = DEFAULT) -> Iterator[Entry]:
    at, first = data.find(b"\x60\xea") if o.look_for_header else 0, True
    while data[at : at + 2] == b"\x60\xea":
        n = struct.unpack_from("<H", data, at + 2)[0]
        if not n:
            return
        head = data[at + 4 : at + 4 + n]
        if zlib.crc32(head) != struct.unpack_from("<I", data, at + 4 + n)[0]:
            raise Damaged("arj header's checksum does not match")
        at += 8 + n
        while size := struct.unpack_from("<H", data, at)[0]:
            at += size + 6
        at += 2
        fixed, version, _, host, flags, method, kind = head[:7]
        time, packed, full, crc = struct.unpack_from("<IIII", head, 8)
        _, access = struct.unpack_from("<HH", head, 24)
        name, comment = [x.decode(o.encoding, "replace") for x in (head[fixed:].split(b"\0") + [b""])[:2]]
        if first:
            first = False
            if flags & 1 or flags & 4:
                raise Unsupported("encrypted or multi-volume arj")
            continue
        if flags & 1:
            raise Unsupported("encrypted arj")
        body = at
        e = Entry("Arj", name, "None" if method == 0 else "Arj", full, packed, crc, dos_time(time), is_directory=kind == 3, check=checksums.crc32 if method <= 4 and kind != 3 else None)
        e.format_meta |= {"version": str(version), "host_os": str(host), "method": str(method), "access_mode": str(access)} | ({"comment": comment} if comment else {})

        def read(body: int = body, packed: int = packed, full: int = full, method: int = method) -> bytes:
            codec = {0: "none", 1: "arj_lha", 2: "arj_lha", 3: "arj_lha", 4: "arj_lh"}.get(method)
            if codec is None or (codec == "arj_lha" and full > 131072):
                raise Unsupported(f"arj method {method}")
            return registry.get(codec).decompress(data[body : body + packed], Context(full, limit=min(full, o.limit(packed))))

        e.read = read
        yield e
        at = body + packed


def ace_entries(data: bytes, o: Options, registry: Registry = DEFAULT) -> Iterator[Entry]:
    magic = data.find(b"**ACE**", 0, 1 << 20 if o.look_for_header else 32)
    if magic < 7:
        raise Damaged("not an ace archive")
    at = magic - 7
    while at + 4 <= len(data):
        crc, n = struct.unpack_from("<HH", data, at)
        head = data[at + 4 : at + 4 + n]
        if len(head) < n or n < 3:
            raise Incomplete("archive ends within a header")
        if checksums.ace_header_crc(head) != crc:
            raise Damaged("ace header's checksum does not match")
        kind, flags = head[0], struct.unpack_from("<H", head, 1)[0]
        at += 4 + n
        if kind == 0:
            if flags & 0x0800:
                raise Unsupported("multi-volume ace")
            continue
        packed = struct.unpack_from("<I", head, 3)[0] if flags & 1 else 0
        if kind == 1:
            full, time, attrib, check = struct.unpack_from("<IIII", head, 7)
            method, quality = head[23], head[24]
            length = struct.unpack_from("<H", head, 29)[0]
            name = head[31 : 31 + length].decode(o.encoding, "replace").replace("\\", "/")
            if flags & 0x4000:
                raise Unsupported("encrypted ace")
            body = at
            split = bool(flags & 0x3000)
            e = Entry("Ace", name, "None" if method == 0 else "AceLZ77", full, packed, check, dos_time(time), is_directory=bool(attrib & 16), is_split_after=bool(flags & 0x2000), check=None if split or attrib & 16 else checksums.crc32_raw)
            e.format_meta |= {"attributes": str(attrib), "quality": str(quality), "method": str(method)}

            def read(body: int = body, packed: int = packed, method: int = method) -> bytes:
                if method:
                    raise Unsupported(f"ace method {method}")
                return data[body : body + packed]

            e.read = read
            yield e
        at += packed


def _vint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def rar_entries(data: bytes, o: Options, registry: Registry = DEFAULT) -> Iterator[Entry]:
    at = data.find(b"Rar!\x1a\x07", 0, (1 << 20) if o.look_for_header else 16)
    if at < 0:
        raise Damaged("not a rar archive")
    yield from _rar5(data, at + 8, o) if data[at + 6] == 1 else _rar4(data, at + 7, o)


def _joined(data: bytes, e: Entry, pieces: list[tuple[int, int]]) -> bytes:
    if not e.is_complete or pieces[-1][0] + pieces[-1][1] > len(data):
        raise Incomplete("a part of the entry is missing")
    return b"".join(data[at : at + n] for at, n in pieces)


def _stored(data: bytes, e: Entry, stored: bool, pieces: list[tuple[int, int]], salt: bytes | None, o: Options) -> None:
    def read() -> bytes:
        if not stored:
            raise Unsupported("of rar before version 5, only stored entries are read")
        raw = _joined(data, e, pieces)
        if not e.is_encrypted:
            return raw
        if salt is None:
            raise Unsupported("a cipher of rar before version 3")
        if o.password is None:
            raise ArchiveError("a password is needed")
        body = crypto.aes_cbc_decrypt(*crypto.rar3_key(o.password, salt), raw)[: e.size]
        if checksums.crc32(body) != e.crc:
            raise crypto.BadPassword("bad password")
        return body

    e.read = read


def _rar5_password(o: Options, rounds: int, salt: bytes, check: bytes) -> bytes:
    """The key, once the password has been found to fit."""
    if o.password is None:
        raise ArchiveError("a password is needed")
    if check and crypto.rar5_check(o.password, salt, rounds) != check[:8]:
        raise crypto.BadPassword("bad password")
    return crypto.rar5_key(o.password, salt, rounds)


def _sealed(data: bytes, at: int, key: bytes) -> tuple[bytes, int]:
    """An encrypted version 5 header behind its vector, and where it ends."""
    iv = data[at : at + 16]
    n, i = _vint(crypto.aes_cbc_decrypt(key, iv, data[at + 16 : at + 32]), 4)
    full = -(-(i + n) // 16) * 16
    if at + 16 + full > len(data):
        raise Incomplete("archive ends within a header")
    return crypto.aes_cbc_decrypt(key, iv, data[at + 16 : at + 16 + full])[: i + n], at + 16 + full


class _Rar5Stream:
    """Contents in order: a solid entry needs those before it decoded."""

    def __init__(self, data: bytes, o: Options):
        self.data, self.o, self.parts, self.decoder, self.next = data, o, [], rar5.Decoder(), 0

    def put(self, e: Entry, method: int, pieces: list[tuple[int, int]], crypt: tuple[int, bytes, bytes, bytes] | None) -> None:
        at = len(self.parts)
        self.parts.append((e, method, pieces, crypt))
        e.read = lambda: self.read(at)

    def raw(self, at: int) -> bytes:
        e, _, pieces, crypt = self.parts[at]
        raw = _joined(self.data, e, pieces)
        if crypt is None:
            return raw
        if self.o.password is None:
            raise ArchiveError("a password is needed")
        rounds, salt, iv, check = crypt
        return crypto.aes_cbc_decrypt(_rar5_password(self.o, rounds, salt, check), iv, raw)

    def read(self, at: int) -> bytes:
        e, method, _, _ = self.parts[at]
        _guard(e.size, len(self.data), self.o)
        if not method:
            return self.raw(at)[: e.size]
        first = at
        while self.parts[first][0].is_solid and first > 0 and first != self.next:
            first -= 1
        out = b""
        for i in range(first, at + 1):
            x, m, _, _ = self.parts[i]
            if m and not x.is_directory:
                out = self.decoder.unpack(self.raw(i), x.size, x.is_solid)
                self.next = i + 1
        return out


def _rar4(data: bytes, at: int, o: Options) -> Iterator[Entry]:
    """Volumes come one after another in data; an entry that goes on in the next one is
    yielded when its last part has been seen."""
    waiting: tuple[Entry, list[tuple[int, int]]] | None = None
    volume, sealed = 0, False
    while at + 7 <= len(data):
        if data[at : at + 7] == b"Rar!\x1a\x07\0":
            at, volume, sealed = at + 7, volume + 1, False
            continue
        head, body = (data[at : at + 65536], None) if not sealed else _sealed3(data, at, o)
        _, kind, flags, n = struct.unpack_from("<HBHH", head)
        if n < 7:
            raise Damaged("rar header without a size")
        body = at + n if body is None else body
        packed = struct.unpack_from("<I", head, 7)[0] if flags & 0x8000 or kind == 0x74 else 0
        if zlib.crc32(head[2:n]) & 0xFFFF != struct.unpack_from("<H", head)[0] and kind in (0x73, 0x74):
            raise Damaged("rar header's checksum does not match")
        if kind == 0x73 and flags & 0x80:
            if o.password is None:
                raise ArchiveError("a password is needed")
            sealed, at = True, at + n
            continue
        if kind == 0x7B and data[body : body + 7] != b"Rar!\x1a\x07\0":
            break
        if kind == 0x74:
            full, host, crc, time, version, method, length, attrib = struct.unpack_from("<IBIIBBHI", head, 11)
            i = 32
            if flags & 0x100:
                high, high_full = struct.unpack_from("<II", head, i)
                packed, full, i = packed | high << 32, full | high_full << 32, i + 8
            raw, salt = head[i : i + length], head[i + length : i + length + 8] if flags & 0x400 else None
            name = raw.split(b"\0")[0].decode("utf-8", "replace") if flags & 0x200 and b"\0" not in raw else rar_name(raw) if flags & 0x200 else raw.decode(o.encoding, "replace")
            e = Entry("Rar", name.replace("\\", "/"), "None" if method == 0x30 else "Rar", full, packed, crc, dos_time(time), is_directory=flags & 0xE0 == 0xE0, is_encrypted=bool(flags & 4), is_split_after=bool(flags & 2), is_solid=bool(flags & 16), is_complete=not flags & 3, volume_index_first=volume, volume_index_last=volume, attrib=attrib - (attrib >> 31 << 32), check=None if flags & 4 or flags & 0xE0 == 0xE0 else checksums.crc32)
            e.format_meta |= {"version": str(version), "host_os": str(host), "format_version": "4"}
            if flags & 1 and waiting and waiting[0].key == e.key:
                e, part = waiting[0], e
                waiting[1].append((body, packed))
                e.compressed_size += packed
                e.crc, e.volume_index_last, e.is_complete, e.is_split_after = part.crc, volume, not flags & 2, part.is_split_after
            else:
                if waiting:
                    yield waiting[0]
                pieces = [(body, packed)]
                _stored(data, e, method == 0x30, pieces, salt, o)
                waiting = (e, pieces)
            if not flags & 2:
                waiting = None
                yield e
        at = body + packed
    if waiting:
        yield waiting[0]


def _sealed3(data: bytes, at: int, o: Options) -> tuple[bytes, int]:
    """An encrypted version 3 header behind its salt, and where its content starts."""
    key, iv = crypto.rar3_key(o.password, data[at : at + 8])
    n = struct.unpack_from("<H", crypto.aes_cbc_decrypt(key, iv, data[at + 8 : at + 24]), 5)[0]
    full = -(-max(n, 7) // 16) * 16
    if at + 8 + full > len(data):
        raise crypto.BadPassword("bad password, or the archive ends within a header")
    return crypto.aes_cbc_decrypt(key, iv, data[at + 8 : at + 8 + full]), at + 8 + full


def rar_name(raw: bytes) -> str:
    """A version 4 name: plain bytes, a zero, and how they become UTF-16."""
    plain, _, code = raw.partition(b"\0")
    if not code:
        return plain.decode("utf-8", "replace")
    out, high, i, flags, left = [], code[0], 1, 0, 0
    while i < len(code):
        if not left:
            flags, left, i = code[i], 8, i + 1
            if i >= len(code):
                break
        kind, flags, left = flags >> 6, flags << 2 & 255, left - 2
        if kind == 0:
            out.append(code[i])
            i += 1
        elif kind == 1:
            out.append(code[i] | high << 8)
            i += 1
        elif kind == 2:
            out.append(int.from_bytes(code[i : i + 2], "little"))
            i += 2
        else:
            n, i = code[i], i + 1
            if n & 128:
                shift, i = code[i], i + 1
                out += [(plain[len(out)] + shift & 255) | high << 8 for _ in range((n & 127) + 2) if len(out) < len(plain)]
            else:
                k = len(out)
                out += plain[k : k + n + 2]
    return b"".join(struct.pack("<H", c) for c in out).decode("utf-16-le", "replace")


def _rar5(data: bytes, at: int, o: Options) -> Iterator[Entry]:
    stream, volume, key = _Rar5Stream(data, o), 0, None
    waiting: tuple[Entry, list[tuple[int, int]]] | None = None
    while at + 7 <= len(data):
        if data[at : at + 8] == b"Rar!\x1a\x07\x01\0":
            at, volume, key = at + 8, volume + 1, None
            continue
        if key is None:
            n, i = _vint(data, at + 4)
            head, end = data[at : i + n], i + n
        else:
            head, end = _sealed(data, at, key)
        if len(head) < 7 or zlib.crc32(head[4:]) != struct.unpack_from("<I", head)[0]:
            raise Damaged("rar header's checksum does not match")
        _, i = _vint(head, 4)
        kind, i = _vint(head, i)
        flags, i = _vint(head, i)
        extra = packed = 0
        if flags & 1:
            extra, i = _vint(head, i)
        if flags & 2:
            packed, i = _vint(head, i)
        if kind == 4:
            _, i = _vint(head, i)
            own, i = _vint(head, i)
            key = _rar5_password(o, head[i], head[i + 1 : i + 17], head[i + 17 : i + 29] if own & 1 else b"")
            at = end
            continue
        if kind == 5 and data[end : end + 8] != b"Rar!\x1a\x07\x01\0":
            break
        if kind == 2:
            own, i = _vint(head, i)
            full, i = _vint(head, i)
            attrib, i = _vint(head, i)
            mtime = check = None
            if own & 2:
                mtime, i = unix_time(struct.unpack_from("<I", head, i)[0]), i + 4
            if own & 4:
                check, i = struct.unpack_from("<I", head, i)[0], i + 4
            method, i = _vint(head, i)
            host, i = _vint(head, i)
            length, i = _vint(head, i)
            name = head[i : i + length].decode("utf-8", "replace")
            e = Entry("Rar", name, "None" if not method >> 7 & 7 else "Rar", full, packed, check or 0, mtime, is_directory=bool(own & 1), is_solid=bool(method & 64), is_split_after=bool(flags & 16), is_complete=not flags & 24, volume_index_first=volume, volume_index_last=volume, attrib=attrib if attrib < 1 << 31 else attrib - (1 << 32), check=checksums.crc32 if check is not None else None)
            e.format_meta |= {"version": str(50 + (method & 63)), "host_os": str(host), "format_version": "5"}
            crypt = _rar5_extra(head[len(head) - extra :] if extra else b"", e)
            if e.is_encrypted:
                e.check = None
            if flags & 8 and waiting and waiting[0].key == e.key:
                e, part = waiting[0], e
                waiting[1].append((end, packed))
                e.compressed_size += packed
                e.crc, e.check, e.volume_index_last, e.is_complete, e.is_split_after = part.crc, part.check, volume, not flags & 16, part.is_split_after
            else:
                if waiting:
                    yield waiting[0]
                pieces = [(end, packed)]
                stream.put(e, method >> 7 & 7, pieces, crypt)
                waiting = (e, pieces)
            if not flags & 16:
                waiting = None
                yield e
        at = end + packed
    if waiting:
        yield waiting[0]


def _rar5_extra(raw: bytes, e: Entry) -> tuple[int, bytes, bytes, bytes] | None:
    """Fills in what the extra records say; returns rounds, salt, vector and check of an
    encrypted entry."""
    at, crypt = 0, None
    while at < len(raw):
        n, at = _vint(raw, at)
        end = at + n
        kind, at = _vint(raw, at)
        if kind == 1:
            e.is_encrypted = True
            _, at = _vint(raw, at)
            flags, at = _vint(raw, at)
            crypt = (raw[at], raw[at + 1 : at + 17], raw[at + 17 : at + 33], raw[at + 33 : at + 45] if flags & 1 else b"")
        elif kind == 2:
            _, at = _vint(raw, at)
            e.format_meta["blake2sp"] = raw[at : at + 32].hex()
        elif kind == 3:
            flags, at = _vint(raw, at)
            unix = flags & 1
            for bit, field in ((2, "last_modified"), (4, "created"), (8, "last_accessed")):
                if flags & bit:
                    setattr(e, field, unix_time(struct.unpack_from("<I", raw, at)[0]) if unix else file_time(struct.unpack_from("<Q", raw, at)[0]))
                    at += 4 if unix else 8
        elif kind == 5:
            redirect, at = _vint(raw, at)
            flags, at = _vint(raw, at)
            length, at = _vint(raw, at)
            e.format_meta |= {"redirect_type": str(redirect), "redirect_flags": str(flags), "redirect_target": raw[at : at + length].decode("utf-8", "replace")}
        at = end
    return crypt
