"""Decoders of codecs that no installed library has. Each takes the compressed bytes and
what the container says about the content, and returns the content."""

from __future__ import annotations

from collections.abc import Callable


class FormatError(ValueError):
    """The bytes are not what the format allows."""


class LowBits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.value, self.count = data, at, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            if self.at >= len(self.data) + 8:
                raise FormatError("input ends early")
            b = self.data[self.at] if self.at < len(self.data) else 0
            self.value |= b << self.count
            self.at += 1
            self.count += 8

    def get(self, n: int) -> int:
        self.need(n)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.count -= n
        return out

    def align(self) -> None:
        drop = self.count % 8
        self.value >>= drop
        self.count -= drop


class HighBits:
    """Bits of a byte string, highest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.value, self.count = data, at, 0, 0

    def get(self, n: int) -> int:
        while self.count < n:
            if self.at >= len(self.data) + 8:
                raise FormatError("input ends early")
            self.value = (self.value << 8) | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.count += 8
        self.count -= n
        out = self.value >> self.count
        self.value &= (1 << self.count) - 1
        return out

    @property
    def over(self) -> bool:
        return self.at >= len(self.data) and self.count < 8


def canonical(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of the canonical Huffman code."""
    out, code = {}, 0
    for n in range(1, max(lengths, default=0) + 1):
        for symbol, size in enumerate(lengths):
            if size == n:
                out[n, code] = symbol
                code += 1
        code <<= 1
    return out


def read_code(bits: LowBits | HighBits, codes: dict[tuple[int, int], int], most: int = 24) -> int:
    code = 0
    for n in range(1, most + 1):
        code = (code << 1) | bits.get(1)
        got = codes.get((n, code))
        if got is not None:
            return got
    raise FormatError("no such code")


def _copy(out: bytearray, distance: int, length: int) -> None:
    start = len(out) - distance
    if distance <= 0 or start < 0:
        raise FormatError("distance reaches before the start")
    if distance >= length:
        out += out[start : start + length]
    else:
        part = bytes(out[start:])
        out += (part * (length // distance + 1))[:length]


def inflate64(data: bytes, size: int | None = None) -> bytes:
    """Deflate with a 64 KiB window: length code 285 has 16 extra bits, and there are
    two more distance codes."""
    bits, out = LowBits(data), bytearray()
    lengths = [(3 + i, 0) for i in range(8)]
    base = 11
    for extra in range(1, 6):
        for _ in range(4):
            lengths.append((base, extra))
            base += 1 << extra
    lengths = [*lengths[:28], (3, 16)]
    distances, base = [(1, 0), (2, 0), (3, 0), (4, 0)], 5
    for extra in range(1, 15):
        for _ in range(2):
            distances.append((base, extra))
            base += 1 << extra
    while True:
        last, kind = bits.get(1), bits.get(2)
        if kind == 0:
            bits.align()
            n, check = bits.get(16), bits.get(16)
            if n ^ check != 0xFFFF:
                raise FormatError("stored block's length is wrong")
            out += bytes(bits.get(8) for _ in range(n))
        elif kind == 3:
            raise FormatError("no such block")
        else:
            if kind == 1:
                literal, far = canonical([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), canonical([5] * 32)
            else:
                nl, nd, nc = bits.get(5) + 257, bits.get(5) + 1, bits.get(4) + 4
                order = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
                sizes = [0] * 19
                for i in range(nc):
                    sizes[order[i]] = bits.get(3)
                codes, all_ = canonical(sizes), []
                while len(all_) < nl + nd:
                    s = read_code(bits, codes)
                    if s < 16:
                        all_.append(s)
                    elif s == 16:
                        if not all_:
                            raise FormatError("nothing to repeat")
                        all_ += [all_[-1]] * (3 + bits.get(2))
                    else:
                        all_ += [0] * (3 + bits.get(3) if s == 17 else 11 + bits.get(7))
                literal, far = canonical(all_[:nl]), canonical(all_[nl : nl + nd])
            while True:
                s = read_code(bits, literal)
                if s < 256:
                    out.append(s)
                elif s == 256:
                    break
                else:
                    base, extra = lengths[s - 257]
                    n = base + bits.get(extra)
                    base, extra = distances[read_code(bits, far)]
                    _copy(out, base + bits.get(extra), n)
        if last:
            return bytes(out)


def unlzw(data: bytes, size: int | None = None) -> bytes:
    """The .Z format, header included."""
    if data[:2] != b"\x1f\x9d" or len(data) < 3:
        raise FormatError("not a .Z stream")
    most, block = data[2] & 31, bool(data[2] & 128)
    if not 9 <= most <= 16:
        raise FormatError("no such code size")
    table: list[bytes] = []

    def fresh() -> None:
        table[:] = [bytes([i]) for i in range(256)] + ([b""] if block else [])

    fresh()
    out, width, before = bytearray(), 9, b""
    at, start, total = 0, 3, 8 * (len(data) - 3)
    value = int.from_bytes(data[3:], "little") if len(data) < 1 << 14 else None
    while at + width <= total:
        if value is not None:
            code = (value >> at) & ((1 << width) - 1)
        else:
            i = start + at // 8
            code = (int.from_bytes(data[i : i + 4], "little") >> (at % 8)) & ((1 << width) - 1)
        at += width
        if block and code == 256:
            at += -at % (8 * width) if at % (8 * width) else 0  # codes come in groups of eight
            at, start, total = 0, start + at // 8, total - at
            if value is not None:
                value = int.from_bytes(data[start:], "little")
            fresh()
            width, before = 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and before:
            word = before + before[:1]
        else:
            raise FormatError("code ahead of the table")
        out += word
        if before and len(table) < 1 << most:
            table.append(before + word[:1])
        before = word
        if len(table) + (1 if before else 0) > (1 << width) and width < most:
            at += -at % (8 * width)
            at, start, total = 0, start + at // 8, total - at
            if value is not None:
                value = int.from_bytes(data[start:], "little")
            width += 1
    return bytes(out)


def unshrink(data: bytes, size: int) -> bytes:
    """LZW whose table is partly cleared: code 256 followed by 1 widens codes, by 2
    frees all entries that no other builds on."""
    bits, out, width = LowBits(data), bytearray(), 9
    parent: dict[int, tuple[int, int]] = {}
    free = 257

    def word(code: int) -> bytes:
        part = bytearray()
        while code > 255:
            if code not in parent:
                raise FormatError("code without an entry")
            code, last = parent[code]
            part.append(last)
        part.append(code)
        return bytes(part[::-1])

    before, text = -1, b""
    while len(out) < size:
        code = bits.get(width)
        if code == 256:
            code = bits.get(width)
            if code == 1 and width < 13:
                width += 1
            elif code == 2:
                used = {p for p, _ in parent.values()}
                for x in [x for x in parent if x not in used]:
                    del parent[x]
                free = 257
            else:
                raise FormatError("no such control code")
            continue
        while free in parent:
            free += 1
        if before >= 0:
            known = code < 256 or code in parent
            first = word(code)[0] if known else text[0]
            if free < 8192:
                parent[free] = (before, first)
        text = word(code)
        out += text
        before = code
    return bytes(out[:size])


def expand_reduced(data: bytes, size: int, factor: int) -> bytes:
    """Reduce 1 to 4: bytes by follower sets, then runs and copies behind byte 144."""
    bits = LowBits(data)
    followers: list[list[int]] = [[] for _ in range(256)]
    for i in range(255, -1, -1):
        followers[i] = [bits.get(8) for _ in range(bits.get(6))]
    out, last = bytearray(), 0
    low = (1 << (8 - factor)) - 1
    state, v, length = 0, 0, 0
    while len(out) < size:
        own = followers[last]
        if not own or bits.get(1):
            c = bits.get(8)
        else:
            c = own[bits.get(max(1, (len(own) - 1).bit_length()))]
        last = c
        if state == 0:
            if c == 144:
                state = 1
            else:
                out.append(c)
        elif state == 1:
            if c == 0:
                out.append(144)
                state = 0
            else:
                v, length = c, c & low
                state = 2 if length == low else 3
        elif state == 2:
            length += c
            state = 3
        else:
            distance = (v >> (8 - factor)) * 256 + c + 1
            for _ in range(length + 3):
                out.append(out[-distance] if distance <= len(out) else 0)
            state = 0
    return bytes(out[:size])


def explode(data: bytes, size: int, large: bool, literals: bool) -> bytes:
    """Implode: Shannon-Fano trees for lengths, distances and perhaps literals."""
    bits = LowBits(data)

    def tree(n: int) -> dict[tuple[int, int], int]:
        lengths: list[int] = []
        for _ in range(bits.get(8) + 1):
            b = bits.get(8)
            lengths += [(b & 15) + 1] * ((b >> 4) + 1)
        if len(lengths) != n:
            raise FormatError("tree of a wrong size")
        out, code, step, before = {}, 0, 0, 0
        for i in sorted(range(n), key=lambda i: (lengths[i], i), reverse=True):
            code += step
            if lengths[i] != before:
                before, step = lengths[i], 1 << (16 - lengths[i])
            out[lengths[i], code >> (16 - lengths[i])] = i
        return out

    literal = tree(256) if literals else None
    sizes, far = tree(64), tree(64)
    low, least = 7 if large else 6, 3 if literals else 2
    out = bytearray()
    while len(out) < size:
        if bits.get(1):
            out.append(read_code(bits, literal, 16) if literal else bits.get(8))
            continue
        distance = bits.get(low)
        distance |= read_code(bits, far, 16) << low
        n = read_code(bits, sizes, 16)
        if n == 63:
            n += bits.get(8)
        for _ in range(n + least):
            out.append(out[-distance - 1] if distance < len(out) else 0)
    return bytes(out[:size])


def rle90(data: bytes, size: int | None = None) -> bytes:
    """A byte, 0x90 and n stand for n of the byte; 0x90 and 0 for 0x90 itself."""
    out, i = bytearray(), 0
    while i < len(data):
        b = data[i]
        i += 1
        if b != 0x90:
            out.append(b)
            continue
        if i >= len(data):
            raise FormatError("input ends within a run")
        n = data[i]
        i += 1
        if n == 0:
            out.append(0x90)
        elif not out:
            raise FormatError("a run of nothing")
        else:
            out += bytes([out[-1]]) * (n - 1)
    return bytes(out if size is None else out[:size])


def unsqueeze(data: bytes, size: int | None = None) -> bytes:
    """A Huffman tree as a list of nodes, then its codes; under them RLE90."""
    n = int.from_bytes(data[:2], "little")
    if n > 512 or len(data) < 2 + 4 * n:
        raise FormatError("tree of a wrong size")
    nodes = [tuple(int.from_bytes(data[2 + 4 * i + 2 * k : 4 + 4 * i + 2 * k], "little", signed=True) for k in (0, 1)) for i in range(n)]
    bits, out = LowBits(data, 2 + 4 * n), bytearray()
    while n:
        at = 0
        while at >= 0:
            if at >= n:
                raise FormatError("no such node")
            at = nodes[at][bits.get(1)]
        if -(at + 1) == 256:
            break
        out.append(-(at + 1))
    return rle90(bytes(out), size)


def uncrunch(data: bytes, size: int | None = None) -> bytes:
    """LZW of 9 to 12 bits behind a byte with the largest width; under it RLE90."""
    if not data or data[0] != 12:
        raise FormatError("no such code size")
    stream = b"\x1f\x9d" + bytes([12 | 128]) + data[1:]
    return rle90(unlzw(stream), size)


def adc(data: bytes, size: int | None = None) -> bytes:
    """Apple Data Compression: plain runs, and copies of two forms."""
    out, i = bytearray(), 0
    while i < len(data) and (size is None or len(out) < size):
        b = data[i]
        if b & 0x80:
            n = (b & 0x7F) + 1
            if i + 1 + n > len(data):
                raise FormatError("input ends within a run")
            out += data[i + 1 : i + 1 + n]
            i += 1 + n
        elif b & 0x40:
            if i + 3 > len(data):
                raise FormatError("input ends within a copy")
            _copy(out, int.from_bytes(data[i + 1 : i + 3], "big") + 1, (b & 0x3F) + 4)
            i += 3
        else:
            if i + 2 > len(data):
                raise FormatError("input ends within a copy")
            _copy(out, ((b & 3) << 8 | data[i + 1]) + 1, (b >> 2 & 15) + 3)
            i += 2
    return bytes(out)


def unlha(data: bytes, size: int) -> bytes:
    """ARJ's methods 1 to 3: blocks of a static Huffman code over literals and lengths,
    with a window of 26,624 bytes."""
    bits, out = HighBits(data), bytearray()

    def lengths(n: int, count_bits: int, gap: int) -> dict[tuple[int, int], int]:
        count = bits.get(count_bits)
        if not count:
            return {(0, 0): bits.get(count_bits)}
        sizes: list[int] = []
        while len(sizes) < count:
            k = bits.get(3)
            if k == 7:
                while bits.get(1):
                    k += 1
            sizes.append(k)
            if len(sizes) == gap:
                sizes += [0] * bits.get(2)
        if len(sizes) > n + 3:
            raise FormatError("too many codes")
        return canonical(sizes[:n])

    def symbol(codes: dict[tuple[int, int], int]) -> int:
        return codes[0, 0] if (0, 0) in codes else read_code(bits, codes, 17)

    left = 0
    main: dict[tuple[int, int], int] = {}
    far: dict[tuple[int, int], int] = {}
    while len(out) < size:
        if not left:
            left = bits.get(16)
            small = lengths(19, 5, 3)
            count = bits.get(9)
            if not count:
                main = {(0, 0): bits.get(9)}
            else:
                sizes: list[int] = []
                while len(sizes) < count:
                    s = symbol(small)
                    if s > 2:
                        sizes.append(s - 2)
                    else:
                        sizes += [0] * (1 if s == 0 else bits.get(4) + 3 if s == 1 else bits.get(9) + 20)
                main = canonical(sizes[:510])
            far = lengths(17, 5, -1)
            if not left:
                raise FormatError("empty block")
        left -= 1
        s = symbol(main)
        if s < 256:
            out.append(s)
        else:
            d = symbol(far)
            d = d if d < 2 else (1 << (d - 1)) + bits.get(d - 1)
            _copy(out, d + 1, s - 253)
    return bytes(out[:size])


def unlh(data: bytes, size: int) -> bytes:
    """ARJ's method 4: lengths and distances in unary-prefixed fields."""
    bits, out = HighBits(data), bytearray()

    def field(low: int, high: int) -> int:
        width, base = low, 0
        while width < high and bits.get(1):
            base += 1 << width
            width += 1
        return base + (bits.get(width) if width else 0)

    while len(out) < size:
        n = field(0, 7)
        if n == 0:
            out.append(bits.get(8))
        else:
            _copy(out, field(9, 13) + 1, n + 2)
    return bytes(out[:size])


DECODERS: dict[str, Callable[..., bytes]] = {"deflate64": inflate64, "lzw": unlzw, "shrink": unshrink, "rle90": rle90, "squeezed": unsqueeze, "crunched": uncrunch, "adc": adc, "arj_lha": unlha, "arj_lh": unlh}
