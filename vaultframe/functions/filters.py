"""Reversible byte filters. Those that liblzma has run there, behind stored LZMA2 chunks;
the others are numpy or plain Python."""

from __future__ import annotations

import lzma
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LIB = {"x86": lzma.FILTER_X86, "ppc": lzma.FILTER_POWERPC, "ia64": lzma.FILTER_IA64, "arm": lzma.FILTER_ARM, "armt": lzma.FILTER_ARMTHUMB, "sparc": lzma.FILTER_SPARC}
NAMES = (*_LIB, "delta", "arm64", "riscv")
_PLAIN = {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16, "preset": 0}


def _stored(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 65536):
        part = data[i : i + 65536]
        out += bytes([1 if i == 0 else 2]) + struct.pack(">H", len(part) - 1) + part
    return bytes(out) + b"\0"


def _unpack(data: bytes, chain: list[dict]) -> bytes:
    return lzma.decompress(data, lzma.FORMAT_RAW, filters=chain)


def _arm64(data: bytes, start: int, encode: bool) -> bytes:
    n = len(data) // 4 * 4
    x = np.frombuffer(data[:n], "<u4").astype(np.uint64)
    pc = np.arange(start, start + n, 4, dtype=np.uint64)
    sign = 1 if encode else -1
    move = lambda v, by: (v.astype(np.int64) + sign * by.astype(np.int64)).astype(np.uint64)
    u = np.uint64
    call = (x >> u(26)) == 0x25
    jumped = u(0x94000000) | (move(x, pc >> u(2)) & u(0x03FFFFFF))
    page = (x & u(0x9F000000)) == 0x90000000
    src = ((x >> u(29)) & u(3)) | ((x >> u(3)) & u(0x1FFFFC))
    page &= ((src + u(0x020000)) & u(0x1C0000)) == 0
    dest = move(src, pc >> u(12))
    high = np.where(dest & u(0x020000), u(0xE00000), u(0))
    paged = (x & u(0x9000001F)) | ((dest & u(3)) << u(29)) | ((dest & u(0x03FFFC)) << u(3)) | high
    out = np.where(call, jumped, np.where(page, paged, x)).astype("<u4")
    return out.tobytes() + data[n:]


def _riscv(data: bytes, start: int, encode: bool) -> bytes:
    """Jumps with a return address (JAL to x1 or x5) and pairs of AUIPC and an instruction
    that uses its register get absolute big-endian targets, two bytes apart at least. A
    pair is marked by AUIPC's register x2; pairs that look so beforehand trade places."""
    out, mask = bytearray(data), 0xFFFFFFFF
    word = lambda at: int.from_bytes(out[at : at + 4], "little")
    x = np.frombuffer(data, np.uint8)[::2]
    i = 0
    for at in (2 * np.flatnonzero((x == 0xEF) | (x & 0x7F == 0x17))).tolist():
        if at < i or at + 8 > len(out):
            continue
        first, pc = word(at), start + at
        if first & 0xFF == 0xEF:
            if first & 0xD00:
                continue
            if encode:  # bits 20, 10-1, 11, 19-12 of the offset, from the top
                offset = (first >> 31 << 20) | ((first >> 21 & 0x3FF) << 1) | ((first >> 20 & 1) << 11) | (first & 0xFF000)
                to = offset + pc & 0x1FFFFF
                out[at + 1 : at + 4] = bytes([first >> 8 & 0x0F | to >> 13 & 0xF0, to >> 9 & 255, to >> 1 & 255])
            else:
                offset = ((first >> 12 & 0x0F) << 17 | (first >> 16 & 255) << 9 | (first >> 24) << 1) - pc & 0x1FFFFF
                new = first & 0xFFF | (offset >> 20) << 31 | (offset >> 1 & 0x3FF) << 21 | (offset >> 11 & 1) << 20 | offset & 0xFF000
                out[at : at + 4] = struct.pack("<I", new)
            i = at + 4
            continue
        second = word(at + 4)
        if first & 0xE80:  # a register other than x0 and x2
            if ((first << 8) ^ (second - 3)) & 0xF8003:
                i = at + 6
                continue
            if encode:
                to = (first & 0xFFFFF000) + (second >> 20) - (second >> 19 & 0x1000) + pc
                out[at : at + 8] = struct.pack("<I", 0x117 | second << 12 & mask) + struct.pack(">I", to & mask)
            else:
                out[at : at + 8] = struct.pack("<II", 0x117 | second << 12 & mask, (first & 0xFFFFF000) + (second >> 20) & mask)
        else:
            register = first >> 27
            if ((first - 0x3117) << 18) & mask >= register & 0x1D:
                i = at + 4
                continue
            if encode:
                out[at : at + 8] = struct.pack("<II", 0x17 | register << 7 | second & 0xFFFFF000, first >> 12 | second << 20 & mask)
            else:
                to = int.from_bytes(out[at + 4 : at + 8], "big") - pc & mask
                out[at : at + 8] = struct.pack("<II", 0x17 | register << 7 | to + 0x800 & 0xFFFFF000, first >> 12 | to << 20 & mask)
        i = at + 8
    return bytes(out)


def apply(name: str, data: bytes, encode: bool = False, distance: int = 1, start: int = 0) -> bytes:
    """Runs a filter over a whole stream. distance: of delta; start: address of the
    first byte, of the branch filters."""
    if not data:
        return b""
    if name == "delta":
        x = np.frombuffer(data, np.uint8)
        if encode:
            out = x.copy()
            out[distance:] -= x[:-distance]
            return out.tobytes()
        pad = -len(x) % distance
        rows = np.concatenate([x, np.zeros(pad, np.uint8)]).reshape(-1, distance)
        return np.cumsum(rows, axis=0, dtype=np.uint8).tobytes()[: len(x)]
    if name == "arm64":
        return _arm64(data, start, encode)
    if name == "riscv":
        return _riscv(data, start, encode)
    if name not in _LIB:
        raise ValueError(f"unknown filter: {name}")
    step = {"id": _LIB[name]} | ({"start_offset": start} if start else {})
    if encode:
        packed = lzma.compress(data, lzma.FORMAT_RAW, filters=[step, _PLAIN])
        return _unpack(packed, [_PLAIN])
    return _unpack(_stored(data), [step, _PLAIN])


class _Bits:
    """Range decoder of BCJ2's fourth stream."""

    def __init__(self, data: bytes):
        self.data, self.at, self.range = data, 5, 0xFFFFFFFF
        self.code = int.from_bytes(data[1:5], "big") if len(data) >= 5 else 0
        self.probs: dict[int, int] = {}

    def bit(self, context: int) -> int:
        p = self.probs.get(context, 1024)
        bound = (self.range >> 11) * p
        if self.code < bound:
            self.range, bit = bound, 0
            self.probs[context] = p + ((2048 - p) >> 5)
        else:
            self.range -= bound
            self.code -= bound
            bit = 1
            self.probs[context] = p - (p >> 5)
        if self.range < 1 << 24:
            self.range = (self.range << 8) & 0xFFFFFFFF
            self.code = ((self.code << 8) | (self.data[self.at] if self.at < len(self.data) else 0)) & 0xFFFFFFFF
            self.at += 1
        return bit


def bcj2(main: bytes, call: bytes, jump: bytes, control: bytes, size: int) -> bytes:
    """The x86 filter with four streams: branch targets travel apart, absolute and big
    endian; a bit says for each branch instruction whether its target does."""
    out, bits = bytearray(), _Bits(control)
    i, at, before = 0, {0: 0, 1: 0}, 0
    while len(out) < size and i < len(main):
        b = main[i]
        i += 1
        out.append(b)
        branch = b & 0xFE == 0xE8 or (before == 0x0F and b & 0xF0 == 0x80)
        if branch and len(out) < size:
            context = 2 + before if b == 0xE8 else 1 if b == 0xE9 else 0
            if bits.bit(context):
                source, k = (call, 0) if b == 0xE8 else (jump, 1)
                target = int.from_bytes(source[at[k] : at[k] + 4], "big")
                at[k] += 4
                out += struct.pack("<I", (target - (len(out) + 4)) & 0xFFFFFFFF)[: size - len(out)]
                before = out[-1]
                continue
        before = b
    return bytes(out)


def filtered(col: Column, name: str, encode: bool = False, distance: int = 1, start: int = 0) -> Column:
    """A binary column after the filter; null for null."""
    if name not in NAMES:
        raise ValueError(f"unknown filter: {name}")

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else apply(name, bytes(x), encode, distance, start))

    return run(col.cast("binary"))
