"""Which format some bytes are, and which files belong together."""

from __future__ import annotations

import bz2
import io
import lzma
import os
import re
import tarfile
import zlib
from collections.abc import Callable, Iterator

import zstandard

from vaultframe.functions.codecs import DEFAULT, Context, Registry
from vaultframe.sources import formats, sevenzip
from vaultframe.sources.model import ArchiveError, Entry, Options

#: Bytes of the start that detection looks at.
HEAD = 1 << 20


def is_tar(head: bytes) -> bool:
    if len(head) < 512:
        return False
    if not any(head[:512]):
        return len(head) >= 1024 and not any(head[:1024])
    try:
        tarfile.TarInfo.frombuf(head[:512], "utf-8", "replace")
        return True
    except tarfile.TarError:
        return False


def _part(f: Callable[[], bytes]) -> bytes:
    try:
        return f()
    except (zlib.error, lzma.LZMAError, OSError, EOFError, zstandard.ZstdError, ValueError):
        return b""


#: Outer codecs of tar, in the order they are tried: name, magic, start of the content.
WRAPPERS: tuple[tuple[str, bytes, str, Callable[[bytes], bytes]], ...] = (
    ("BZip2", b"BZh", "bzip2", lambda d: _part(lambda: bz2.BZ2Decompressor().decompress(d, 2048))),
    ("GZip", b"\x1f\x8b", "gzip", lambda d: _part(lambda: zlib.decompressobj(31).decompress(d, 2048))),
    ("ZStandard", b"\x28\xb5\x2f\xfd", "zstd", lambda d: _part(lambda: zstandard.ZstdDecompressor().stream_reader(io.BytesIO(d)).read(2048))),
    ("LZip", b"LZIP", "lzip", lambda d: _part(lambda: lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 25}]).decompress(d[6:], 2048))),
    ("Xz", b"\xfd7zXZ\x00", "xz", lambda d: _part(lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ).decompress(d, 2048))),
    ("Lzw", b"\x1f\x9d", "lzw", lambda d: _part(lambda: DEFAULT.get("lzw").decompress(d))),
)

EXTENSIONS = {
    "zip": "Zip", "zipx": "Zip", "cbz": "Zip", "rar": "Rar", "cbr": "Rar", "gz": "GZip", "z": "Lzw", "7z": "SevenZip", "arc": "Arc", "arj": "Arj", "ace": "Ace", "tar": "Tar",
    "tgz": "Tar", "taz": "Tar", "tbz": "Tar", "tbz2": "Tar", "tz2": "Tar", "txz": "Tar", "tlz": "Tar", "tzst": "Tar",
}


def _wrapped(data: bytes, o: Options = Options()) -> tuple[str, str] | None:
    """Outer name and codec of a compressed tar. Compressed zeros are a tar without
    entries only if the file's name says so; they may as well be a file of zeros."""
    for name, magic, codec, start in WRAPPERS:
        if data[: len(magic)] == magic:
            head = start(data[:HEAD])
            if is_tar(head) and (any(head[:512]) or EXTENSIONS.get(o.extension.lower().lstrip(".")) == "Tar"):
                return name, codec
    return None


def extension_of(path: str) -> str:
    """The hint that a file's name gives; .tar.gz and its like are one extension."""
    name = path.lower().rsplit("/", 1)[-1]
    return ".tar" if re.search(r"\.tar\.\w+$", name) else os.path.splitext(name)[1]


def _within(data: bytes, magic: bytes, o: Options) -> bool:
    return (magic in data[:HEAD]) if o.look_for_header else data[: len(magic)] == magic


Probe = Callable[[bytes, Options], bool]
Read = Callable[[bytes, Options, Registry], Iterator[Entry]]


def _tar(data: bytes, o: Options, registry: Registry = DEFAULT) -> Iterator[Entry]:
    wrapped = None if is_tar(data[:1024]) else _wrapped(data, o)
    if wrapped is None:
        yield from formats.tar_entries(data, o, registry)
    else:
        yield from formats.tar_entries(registry.get(wrapped[1]).decompress(data, Context(limit=o.whole(len(data)))), o, registry, wrapped[0])


#: Formats in the order they are tried. The first that knows the bytes reads them.
FORMATS: dict[str, tuple[Probe, Read]] = {
    "Zip": (lambda d, o: d[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK00", b"PK\x07\x08") or (o.look_for_header and b"PK\x03\x04" in d[:HEAD] and d.find(b"PK\x05\x06") >= 0), formats.zip_entries),
    "Rar": (lambda d, o: _within(d, b"Rar!\x1a\x07", o), formats.rar_entries),
    "Tar": (lambda d, o: is_tar(d[:1024]) or _wrapped(d, o) is not None, _tar),
    "GZip": (lambda d, o: d[:3] == b"\x1f\x8b\x08", formats.gzip_entries),
    "Lzw": (lambda d, o: d[:2] == b"\x1f\x9d", formats.lzw_entries),
    "Arc": (lambda d, o: len(d) > 1 and d[0] == 0x1A and d[1] < 10, formats.arc_entries),
    "Arj": (lambda d, o: d[:2] == b"\x60\xea", formats.arj_entries),
    "Ace": (lambda d, o: d[7:14] == b"**ACE**", formats.ace_entries),
    "SevenZip": (lambda d, o: _within(d, sevenzip.MAGIC, o), sevenzip.sevenzip_entries),
}


_BUILT_IN = frozenset(FORMATS)


def added() -> dict[str, tuple[Probe, Read]]:
    """Formats that register() added, to be sent along to tasks."""
    return {k: v for k, v in FORMATS.items() if k not in _BUILT_IN}


def register(name: str, probe: Probe, read: Read, extensions: tuple[str, ...] = ()) -> None:
    """Adds a format, tried after the others."""
    FORMATS[name] = (probe, read)
    EXTENSIONS.update(dict.fromkeys(extensions, name))


def detect(data: bytes, o: Options = Options()) -> str | None:
    """The format's name; None if the bytes are no archive."""
    hint = EXTENSIONS.get(o.extension.lower().lstrip("."))
    if hint in ("GZip", "Lzw"):  # what these wrap may be a tar
        hint = "Tar"
    for name in dict.fromkeys([*([hint] if hint else []), *FORMATS]):
        if FORMATS[name][0](data, o):
            return name
    return None


def outer_compression(data: bytes, o: Options = Options()) -> str:
    got = None if is_tar(data[:1024]) else _wrapped(data, o)
    return got[0] if got else "None"


def entries(data: bytes, o: Options = Options(), registry: Registry = DEFAULT) -> Iterator[Entry]:
    name = detect(data, o)
    if name is None:
        raise ArchiveError("no known archive format")
    yield from FORMATS[name][1](data, o, registry)


_VOLUME = (
    (re.compile(r"^(.*)\.part(\d+)\.rar$", re.I), "rar"), (re.compile(r"^(.*)\.r(\d{2})$", re.I), "rar-old"), (re.compile(r"^(.*)\.z(\d{2})$", re.I), "zip"), (re.compile(r"^(.*)\.(\d{3})$"), "split"),
)


def volume_of(path: str) -> tuple[str, int]:
    """(name of the whole, place in it) of a file: .partN.rar, .rar/.rNN, .zip/.zNN and
    .001 parts go together, the .zip last."""
    for pattern, kind in _VOLUME:
        m = pattern.match(path)
        if m:
            n = int(m[2])
            return {"rar": m[1] + ".part.rar", "rar-old": m[1] + ".rar", "zip": m[1] + ".zip", "split": m[1]}[kind], n + 1 if kind == "rar-old" else n - (kind in ("rar", "split"))
    return path, 1 << 20 if path.lower().endswith((".zip", ".zipx")) else 0


def volumes(paths: list[str]) -> dict[str, list[str]]:
    """Whole name -> its parts in order."""
    out: dict[str, list[tuple[int, str]]] = {}
    for p in paths:
        whole, n = volume_of(p)
        out.setdefault(whole, []).append((n, p))
    return {k: [p for _, p in sorted(v)] for k, v in sorted(out.items())}
