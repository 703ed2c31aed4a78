"""RAR version 5 compression: Huffman-coded literals and copies in blocks, four recent
distances, and filters over ranges of the output."""

from __future__ import annotations

import struct

import numpy as np

from vaultframe.functions.legacy import FormatError, HighBits, _copy, canonical, read_code

MAIN, FAR, LOW, REPEAT = 306, 64, 16, 44


class Decoder:
    """Keeps window, tables and distances, which the entries of a solid archive share."""

    def __init__(self) -> None:
        self.out = bytearray()
        self.tables: list[dict[tuple[int, int], int]] = []
        self.distances = [0, 0, 0, 0]
        self.length = 0

    def _lengths(self, bits: HighBits) -> None:
        sizes: list[int] = []
        while len(sizes) < 20:
            n = bits.get(4)
            if n == 15 and (zeros := bits.get(4)):
                sizes += [0] * (zeros + 2)
            else:
                sizes.append(n)
        codes, every = canonical(sizes[:20]), []
        while len(every) < MAIN + FAR + LOW + REPEAT:
            s = read_code(bits, codes)
            if s < 16:
                every.append(s)
                continue
            n = bits.get(3) + 3 if s in (16, 18) else bits.get(7) + 11
            if s < 18 and not every:
                raise FormatError("nothing to repeat")
            every += [every[-1] if s < 18 else 0] * n
        self.tables, at = [], 0
        for n in (MAIN, FAR, LOW, REPEAT):
            self.tables.append(canonical(every[at : at + n]))
            at += n

    @staticmethod
    def _slot(bits: HighBits, slot: int) -> int:
        if slot < 8:
            return 2 + slot
        n = slot // 4 - 1
        return 2 + ((4 | slot & 3) << n) + bits.get(n)

    @staticmethod
    def _value(bits: HighBits) -> int:
        return int.from_bytes(bytes(bits.get(8) for _ in range(bits.get(2) + 1)), "little")

    def unpack(self, data: bytes, size: int, solid: bool = False) -> bytes:
        if not solid:
            self.__init__()
        start, at, filters, last = len(self.out), 0, [], False
        while len(self.out) - start < size and not last:
            if at + 3 > len(data):
                raise FormatError("input ends early")
            flags, n = data[at], (data[at] >> 3 & 3) + 1
            raw = data[at + 2 : at + 2 + n]
            check = 0x5A ^ flags
            for b in raw:
                check ^= b
            if n > 3 or check != data[at + 1]:
                raise FormatError("block header's checksum does not match")
            length = int.from_bytes(raw, "little")
            at += 2 + n
            body = data[at : at + length]
            end = 8 * (length - 1) + (flags & 7) + 1
            bits = HighBits(body)
            if flags & 0x80:
                self._lengths(bits)
            if not self.tables:
                raise FormatError("a first block without tables")
            self._block(bits, end, start + size, start, filters)
            last = bool(flags & 0x40)
            at += length
        if len(self.out) - start < size:
            raise FormatError("input ends early")
        got = bytearray(self.out[start : start + size])
        for at, length, kind, channels in filters:
            got[at : at + length] = _filtered(bytes(got[at : at + length]), kind, channels, at)
        return bytes(got)

    def _block(self, bits: HighBits, end: int, stop: int, start: int, filters: list) -> None:
        main, far, low, repeat = self.tables
        out, recent = self.out, self.distances
        while 8 * bits.at - bits.count < end and len(out) < stop:
            s = read_code(bits, main)
            if s < 256:
                out.append(s)
            elif s == 256:
                at, n, kind = self._value(bits), self._value(bits), bits.get(3)
                filters.append((len(out) - start + at, n, kind, bits.get(5) + 1 if kind == 0 else 0))
            elif s == 257:
                if self.length:
                    _copy(out, recent[0], self.length)
            elif s < 262:
                recent.insert(0, recent.pop(s - 258))
                self.length = self._slot(bits, read_code(bits, repeat))
                _copy(out, recent[0], self.length)
            else:
                n, slot = self._slot(bits, s - 262), read_code(bits, far)
                if slot < 4:
                    d = 1 + slot
                else:
                    k = slot // 2 - 1
                    d = 1 + ((2 | slot & 1) << k)
                    d += (bits.get(k - 4) << 4) + read_code(bits, low) if k >= 4 else bits.get(k)
                n += (d > 0x100) + (d > 0x2000) + (d > 0x40000)
                recent.insert(0, d)
                recent.pop()
                self.length = n
                _copy(out, d, n)


def _filtered(x: bytes, kind: int, channels: int, at: int) -> bytes:
    """kind: 0 delta by channels, 1 and 2 x86 calls (and jumps), 3 ARM branches."""
    if kind == 0:
        out, k = np.zeros(len(x), np.uint8), 0
        raw = np.frombuffer(x, np.uint8)
        for c in range(channels):
            n = len(range(c, len(x), channels))
            out[c::channels] = -np.cumsum(raw[k : k + n], dtype=np.uint8)
            k += n
        return out.tobytes()
    out = bytearray(x)
    if kind in (1, 2):
        i = 0
        while i + 4 < len(out):
            i += 1
            if out[i - 1] == 0xE8 or (kind == 2 and out[i - 1] == 0xE9):
                here = (i + at) & 0xFFFFFF
                (a,) = struct.unpack_from("<I", out, i)
                if a & 0x80000000:
                    if not (a + here) & 0x80000000:
                        struct.pack_into("<I", out, i, (a + 0x1000000) & 0xFFFFFFFF)
                elif (a - 0x1000000) & 0x80000000:
                    struct.pack_into("<I", out, i, (a - here) & 0xFFFFFFFF)
                i += 4
    elif kind == 3:
        for i in range(0, len(out) - 3, 4):
            if out[i + 3] == 0xEB:
                v = int.from_bytes(out[i : i + 3], "little") - (at + i) // 4
                out[i : i + 3] = (v & 0xFFFFFF).to_bytes(3, "little")
    else:
        raise FormatError("no such filter")
    return bytes(out)
