"""PPMd, variant H, with the range coder that 7z has: prediction by partial matching.

Contexts are objects, a successor is a context or a place in the text read so far. The
format restarts its model when a fixed memory is used up in its own allocator's way; as
that is not followed here, a stream that may get there is refused instead."""

from __future__ import annotations

from vaultframe.functions.legacy import FormatError

#: Fixed values of the format.
MAX_FREQ, INT_BITS, PERIOD_BITS, UNIT = 124, 7, 7, 12
SCALE = 1 << (INT_BITS + PERIOD_BITS)
ESCAPES = (0x3CDD, 0x1F3F, 0x59BF, 0x48F3, 0x64A1, 0x5ABC, 0x6632, 0x6051)
EXP_ESCAPE = (25, 14, 9, 7, 5, 5, 4, 4, 4, 3, 3, 3, 2, 2, 2, 2)
SYMBOL, FREQ, NEXT = range(3)


def _see_index() -> list[int]:
    out, m, k = [0, 1, 2], 3, 1
    while len(out) < 256:
        out.append(m)
        k -= 1
        if not k:
            m += 1
            k = m - 2
    return out


SEE_INDEX = _see_index()
BINARY_INDEX = [0, 2] + [4] * 9 + [6] * 245


class Context:
    __slots__ = ("stats", "suffix", "total")

    def __init__(self, stats: list, total: int, suffix: Context | None):
        self.stats, self.total, self.suffix = stats, total, suffix


class See:
    __slots__ = ("count", "shift", "sum")

    def __init__(self, total: int, shift: int, count: int):
        self.sum, self.shift, self.count = total, shift, count

    def hit(self) -> None:
        if self.shift < PERIOD_BITS:
            self.count -= 1
            if not self.count:
                self.sum = self.sum << 1 & 0xFFFF
                self.count = 3 << self.shift & 255
                self.shift += 1


class Model:
    """coder: what codes an interval and tells which one comes; both directions run the
    same steps, and coder.pick() answers with the symbol's place."""

    def __init__(self, order: int, memory: int, coder):
        if not 2 <= order <= 64 or memory < 1 << 11:
            raise FormatError("no such order or memory")
        self.order, self.memory, self.coder, self.used = order, memory, coder, 0
        self.start()

    def take(self, units: int) -> None:
        self.used += units * UNIT
        if self.used > self.memory // 8 * 7 - 16 * UNIT or len(self.text) > self.memory // 8 - UNIT:
            raise FormatError("the model would outgrow its memory")

    def start(self) -> None:
        self.text = bytearray(1)
        self.fall = self.order
        self.run = self.first_run = -min(self.order, 12) - 1
        self.success = self.high = self.escape = 0
        self.low = self.top = Context([[i, 1, None] for i in range(256)], 257, None)
        self.found = self.low.stats[0]
        self.binary = [[(SCALE - ESCAPES[k & 7] // (i + 2)) for k in range(64)] for i in range(128)]
        self.see = [[See((5 * i + 10) << (PERIOD_BITS - 4), PERIOD_BITS - 4, 4) for _ in range(16)] for i in range(25)]
        self.dummy = See(0, PERIOD_BITS, 64)
        self.take(256 * 6 // UNIT + 1)

    def grow(self, skip: bool) -> Context:
        """Contexts for the symbol found, in all suffixes that have none yet."""
        c, up, waiting = self.low, self.found[NEXT], []
        if not skip:
            waiting.append(self.found)
        while c.suffix is not None:
            c = c.suffix
            s = next(x for x in c.stats if x[SYMBOL] == self.found[SYMBOL])
            if s[NEXT] is not up and s[NEXT] != up:
                c = s[NEXT]
                if not waiting:
                    return c
                break
            waiting.append(s)
        symbol = self.text[up]
        if len(c.stats) == 1:
            freq = c.stats[0][FREQ]
        else:
            cf = next(x for x in c.stats if x[SYMBOL] == symbol)[FREQ] - 1
            rest = c.total - len(c.stats) - cf
            freq = 1 + ((5 * cf > rest) if 2 * cf <= rest else (2 * cf + 3 * rest - 1) // (2 * rest))
        for s in reversed(waiting):
            self.take(1)
            c = Context([[symbol, freq, up + 1]], 0, c)
            s[NEXT] = c
        return c

    def update(self) -> None:
        found, low = self.found, self.low
        symbol, following = found[SYMBOL], found[NEXT]
        if found[FREQ] < MAX_FREQ // 4 and low.suffix is not None:
            c = low.suffix
            if len(c.stats) == 1:
                if c.stats[0][FREQ] < 32:
                    c.stats[0][FREQ] += 1
            else:
                i = next(k for k, x in enumerate(c.stats) if x[SYMBOL] == symbol)
                if i and c.stats[i][FREQ] >= c.stats[i - 1][FREQ]:
                    c.stats[i], c.stats[i - 1] = c.stats[i - 1], c.stats[i]
                    i -= 1
                if c.stats[i][FREQ] < MAX_FREQ - 9:
                    c.stats[i][FREQ] += 2
                    c.total += 2
        if not self.fall:
            self.low = self.top = found[NEXT] = self.grow(True)
            return
        self.text.append(symbol)
        self.take(0)
        successor: Context | int = len(self.text)
        if following is not None:
            if not isinstance(following, Context):
                following = self.grow(False)
            self.fall -= 1
            if not self.fall:
                successor = following
                if self.top is not low:
                    self.text.pop()
        else:
            found[NEXT] = successor
            following = low
        ns = len(low.stats)
        s0 = low.total - ns - (found[FREQ] - 1)
        c = self.top
        while c is not low:
            n = len(c.stats)
            if n != 1:
                if n % 2 == 0:
                    self.take(n // 2 + 1)
                c.total += (2 * n < ns) + 2 * ((4 * n <= ns) & (c.total <= 8 * n))
            else:
                self.take(1)
                s = c.stats[0]
                s[FREQ] = s[FREQ] * 2 if s[FREQ] < MAX_FREQ // 4 - 1 else MAX_FREQ - 4
                c.total = s[FREQ] + self.escape + (ns > 3)
            cf, sf = 2 * found[FREQ] * (c.total + 6), s0 + c.total
            if cf < 6 * sf:
                cf = 1 + (cf > sf) + (cf >= 4 * sf)
                c.total += 3
            else:
                cf = 4 + (cf >= 9 * sf) + (cf >= 12 * sf) + (cf >= 15 * sf)
                c.total += cf
            c.stats.append([symbol, cf, successor])
            c = c.suffix
        self.low = self.top = following

    def rescale(self) -> None:
        low, found = self.low, self.found
        stats = low.stats
        stats.remove(found)
        stats.insert(0, found)
        escape = low.total - found[FREQ]
        adder = int(self.fall != 0)
        found[FREQ] = (found[FREQ] + 4 + adder) >> 1
        total = found[FREQ]
        for i in range(1, len(stats)):
            s = stats[i]
            escape -= s[FREQ]
            s[FREQ] = (s[FREQ] + adder) >> 1
            total += s[FREQ]
            if s[FREQ] > stats[i - 1][FREQ]:
                j = i
                while j > 0 and (j == i or s[FREQ] > stats[j - 1][FREQ]):
                    stats[j] = stats[j - 1]
                    j -= 1
                stats[j] = s
        gone = 0
        while not stats[-1][FREQ]:
            stats.pop()
            gone += 1
        if gone:
            escape += gone
            if len(stats) == 1:
                s = stats[0]
                while True:
                    s[FREQ] -= s[FREQ] >> 1
                    escape >>= 1
                    if escape <= 1:
                        break
                self.found = s
                return
        low.total = total + escape - (escape >> 1)
        self.found = stats[0]

    def follow(self) -> None:
        c = self.found[NEXT]
        if not self.fall and isinstance(c, Context):
            self.low = self.top = c
        else:
            self.update()

    def symbol(self, wanted: int | None = None) -> int | None:
        """Codes one symbol (wanted; -1 is the end), or decodes it; None is the end."""
        low, coder = self.low, self.coder
        if len(low.stats) != 1:
            stats = low.stats
            i, start = coder.pick(stats, low.total, wanted)
            if i is not None:
                s = stats[i]
                coder.code(start, s[FREQ])
                if not i:
                    self.success = int(2 * s[FREQ] > low.total)
                    self.run += self.success
                else:
                    self.success = 0
                self.found = s
                low.total += 4
                s[FREQ] += 4
                if i and s[FREQ] > stats[i - 1][FREQ]:
                    stats[i], stats[i - 1] = stats[i - 1], s
                if s[FREQ] > MAX_FREQ:
                    self.rescale()
                got = s[SYMBOL]
                self.follow()
                return got
            self.success = 0
            self.high = 8 if self.found[SYMBOL] >= 0x40 else 0
            coder.code(start, low.total - start)
            masked = {s[SYMBOL] for s in stats}
        else:
            s = low.stats[0]
            self.high = 8 if self.found[SYMBOL] >= 0x40 else 0
            row = self.binary[s[FREQ] - 1]
            k = self.success + BINARY_INDEX[len(low.suffix.stats) - 1] + self.high + (16 if s[SYMBOL] >= 0x40 else 0) + (32 if self.run < 0 else 0)
            p = row[k]
            mean = (p + (1 << (PERIOD_BITS - 2))) >> PERIOD_BITS
            if not coder.bit(p, None if wanted is None else wanted != s[SYMBOL]):
                row[k] = p + (1 << INT_BITS) - mean
                self.found = s
                s[FREQ] += s[FREQ] < 128
                self.success = 1
                self.run += 1
                got = s[SYMBOL]
                self.follow()
                return got
            row[k] = p - mean
            self.escape = EXP_ESCAPE[row[k] >> 10]
            masked = {s[SYMBOL]}
            self.success = 0
        while True:
            n = len(self.low.stats)
            while True:
                self.fall += 1
                if self.low.suffix is None:
                    return None
                self.low = low = self.low.suffix
                if len(low.stats) != n:
                    break
            open_ = [s for s in low.stats if s[SYMBOL] not in masked]
            if len(low.stats) != 256:
                k = len(open_)
                see = self.see[SEE_INDEX[k - 1]][(k < len(low.suffix.stats) - len(low.stats)) + 2 * (low.total < 11 * len(low.stats)) + 4 * (n > k) + self.high]
                r = see.sum >> see.shift
                see.sum -= r
                escape = r + (r == 0)
            else:
                see, escape = self.dummy, 1
            total = sum(s[FREQ] for s in open_) + escape
            i, start = coder.pick(open_, total, wanted)
            if i is not None:
                s = open_[i]
                coder.code(start, s[FREQ])
                see.hit()
                self.found = s
                low.total += 4
                s[FREQ] += 4
                if s[FREQ] > MAX_FREQ:
                    self.rescale()
                self.run = self.first_run
                got = s[SYMBOL]
                self.update()
                return got
            coder.code(start, total - start)
            see.sum = see.sum + total & 0xFFFF
            masked.update(s[SYMBOL] for s in open_)


class Decoder:
    def __init__(self, data: bytes):
        if len(data) < 5 or data[0]:
            raise FormatError("not a PPMd stream")
        self.data, self.at, self.range, self.value = data, 5, 0xFFFFFFFF, int.from_bytes(data[1:5], "big")

    def fill(self) -> None:
        while self.range < 1 << 24:
            if self.at > len(self.data) + 8:
                raise FormatError("input ends early")
            self.value = (self.value << 8 | (self.data[self.at] if self.at < len(self.data) else 0)) & 0xFFFFFFFF
            self.range = self.range << 8 & 0xFFFFFFFF
            self.at += 1

    def pick(self, stats: list, total: int, wanted: int | None) -> tuple[int | None, int]:
        """The place of the state whose interval comes, None for what is left; where the
        interval starts."""
        self.range //= total
        count, start = self.value // self.range, 0
        if count >= total:
            raise FormatError("no such interval")
        for i, s in enumerate(stats):
            if start + s[FREQ] > count:
                return i, start
            start += s[FREQ]
        return None, start

    def code(self, start: int, size: int) -> None:
        self.value -= start * self.range
        self.range *= size
        self.fill()

    def bit(self, p: int, wanted: bool | None) -> bool:
        bound = (self.range >> (INT_BITS + PERIOD_BITS)) * p
        one = self.value >= bound
        if one:
            self.value -= bound
            self.range -= bound
        else:
            self.range = bound
        self.fill()
        return one


class Encoder:
    def __init__(self):
        self.out, self.low, self.range, self.cache, self.held = bytearray(), 0, 0xFFFFFFFF, 0, 1

    def shift(self) -> None:
        if self.low < 0xFF000000 or self.low >> 32:
            carry, byte = self.low >> 32, self.cache
            for _ in range(self.held):
                self.out.append(byte + carry & 255)
                byte = 0xFF
            self.held, self.cache = 0, self.low >> 24 & 255
        self.held += 1
        self.low = self.low << 8 & 0xFFFFFFFF

    def fill(self) -> None:
        while self.range < 1 << 24:
            self.range = self.range << 8 & 0xFFFFFFFF
            self.shift()

    def pick(self, stats: list, total: int, wanted: int | None) -> tuple[int | None, int]:
        self.range //= total
        start = 0
        for i, s in enumerate(stats):
            if s[SYMBOL] == wanted:
                return i, start
            start += s[FREQ]
        return None, start

    def code(self, start: int, size: int) -> None:
        self.low += start * self.range
        self.range *= size
        self.fill()

    def bit(self, p: int, wanted: bool | None) -> bool:
        bound = (self.range >> (INT_BITS + PERIOD_BITS)) * p
        if wanted:
            self.low += bound
            self.range -= bound
        else:
            self.range = bound
        self.fill()
        return bool(wanted)


def decode(data: bytes, size: int, order: int = 6, memory: int = 1 << 24) -> bytes:
    out = bytearray()
    if size:
        model = Model(order, memory, Decoder(data))
        while len(out) < size:
            got = model.symbol()
            if got is None:
                raise FormatError("input ends early")
            out.append(got)
    return bytes(out)


def encode(data: bytes, order: int = 6, memory: int = 1 << 24) -> bytes:
    coder = Encoder()
    model = Model(order, memory, coder)
    for b in data:
        model.symbol(b)
    for _ in range(5):
        coder.shift()
    return bytes(coder.out)
