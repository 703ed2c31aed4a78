"""Checksums as plain functions and as columns. What Spark has stays in the JVM."""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@cache
def _table(poly: int, mask: int) -> tuple[int, ...]:
    """A reflected CRC's byte table, from its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (poly if n & 1 else 0)
        out.append(n & mask)
    return tuple(out)


def _times(poly: int, bits: int, a: np.ndarray, zeros: int) -> np.ndarray:
    """Registers of a reflected CRC after so many zero bytes: by squaring the linear map
    of one byte, held as the image of each bit."""
    table = _table(poly, (1 << bits) - 1)
    step = [table[1 << i] if i < 8 else 1 << (i - 8) for i in range(bits)]

    def through(images: list[int], x: int) -> int:
        out, i = 0, 0
        while x:
            if x & 1:
                out ^= images[i]
            x, i = x >> 1, i + 1
        return out

    while zeros:
        if zeros & 1:
            out = np.zeros_like(a)
            for i, image in enumerate(step):
                out ^= np.where(a >> np.uint64(i) & np.uint64(1), np.uint64(image), np.uint64(0))
            a = out
        step = [through(step, x) for x in step]
        zeros >>= 1
    return a


#: Bytes that one lane takes, at least, where a content is cut into lanes.
LANE = 256


def _reflected(data: bytes, poly: int, bits: int, start: int, final: int) -> int:
    """Lanes of equal length advance together, a byte a step, and are then combined: the
    CRC of joined parts is that of the first, shifted past the second, with its own."""
    table, crc, n = _table(poly, (1 << bits) - 1), start, len(data)
    lanes = 1 << max(0, (n // LANE).bit_length() - 1) if n >= 16 * LANE else 0
    size = n // lanes if lanes else 0
    if lanes:
        x = np.frombuffer(data, np.uint8)[: lanes * size].reshape(lanes, size).T.astype(np.uint64)
        look, state = np.array(table, np.uint64), np.zeros(lanes, np.uint64)
        state[0] = crc
        for row in x:
            state = look[(state ^ row) & np.uint64(255)] ^ (state >> np.uint64(8))
        while len(state) > 1:
            state = _times(poly, bits, state[::2], size) ^ state[1::2]
            size *= 2
        crc = int(state[0])
    for b in data[size if lanes else 0 :]:
        crc = table[(crc ^ b) & 255] ^ (crc >> 8)
    return crc ^ final


_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def crc32(data: bytes, seed: int = 0) -> int:
    return zlib.crc32(data, seed)


def crc32_custom(data: bytes, poly: int = 0xEDB88320, seed: int = 0xFFFFFFFF, final: int = 0xFFFFFFFF) -> int:
    return _reflected(data, poly, 32, seed, final)


def crc32_raw(data: bytes) -> int:
    """CRC-32 without the final complement, as ACE entries carry it."""
    return zlib.crc32(data) ^ 0xFFFFFFFF


def crc16_arc(data: bytes) -> int:
    return _reflected(data, 0xA001, 16, 0, 0)


def ace_header_crc(data: bytes) -> int:
    return crc32_raw(data) & 0xFFFF


def crc64_xz(data: bytes) -> int:
    return _reflected(data, 0xC96C5795D7870F42, 64, (1 << 64) - 1, (1 << 64) - 1)


def crc64_iso(data: bytes, seed: int = 0) -> int:
    return _reflected(data, 0xD800000000000000, 64, seed, 0)


def adler32(data: bytes, seed: int = 1) -> int:
    return zlib.adler32(data, seed)


def bzip2_crc(data: bytes) -> int:
    """CRC-32 of the highest bit first, of a bzip2 block's bytes."""
    mirrored = zlib.crc32(data.translate(_MIRROR))  # the same CRC with all bits turned round
    return int(f"{mirrored:032b}"[::-1], 2)


def blake2sp(data: bytes) -> bytes:
    """Eight BLAKE2s leaves over interleaved 64-byte blocks, and a root over these."""
    leaves = []
    for i in range(8):
        part = b"".join(data[o : o + 64] for o in range(64 * i, len(data), 512))
        leaves.append(hashlib.blake2s(part, digest_size=32, fanout=8, depth=2, leaf_size=0, node_offset=i, node_depth=0, inner_size=32, last_node=i == 7).digest())
    return hashlib.blake2s(b"".join(leaves), digest_size=32, fanout=8, depth=2, leaf_size=0, node_offset=0, node_depth=1, inner_size=32, last_node=True).digest()


ALGORITHMS = {
    "crc32": crc32, "crc32_raw": crc32_raw, "crc16_arc": crc16_arc, "ace_header_crc": ace_header_crc, "crc64_xz": crc64_xz, "crc64_iso": crc64_iso, "adler32": adler32, "bzip2_crc": bzip2_crc,
}


def checksum(col: Column, algorithm: str) -> Column:
    """An integer checksum of a binary column; null for null. 64-bit ones are decimals."""
    col = col.cast("binary")
    if algorithm == "crc32":
        return F.crc32(col)
    if algorithm == "crc32_raw":
        return F.crc32(col).bitwiseXOR(F.lit(0xFFFFFFFF))
    if algorithm == "ace_header_crc":
        return F.crc32(col).bitwiseXOR(F.lit(0xFFFFFFFF)).bitwiseAND(F.lit(0xFFFF))
    function = ALGORITHMS[algorithm]
    wide = algorithm.startswith("crc64")

    @F.pandas_udf(T.StringType() if wide else T.LongType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else (str(function(bytes(x))) if wide else function(bytes(x)))).astype(object if wide else "Int64")

    return run(col).cast("decimal(20,0)") if wide else run(col)


def blake2sp_hex(col: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else blake2sp(bytes(x)).hex())

    return run(col.cast("binary"))
