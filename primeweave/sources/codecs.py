"""Byte and bit codecs: VByte, MSB-first bits, centred minimal binary, interpolative coding, Elias gamma, rANS, model tables."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

U64 = 1 << 64
#: Fixed values of the entropy coder: 16-bit probabilities, 32-bit states that rest at RANS_LOW.
PROB_BITS, RANS_LOW, BLOCK_SYMBOLS = 16, 1 << 23, 1 << 20


class FormatError(ValueError):
    """A container breaks its format."""


def vbyte(v: int) -> bytes:
    """Seven bits a byte, low ones first; the high bit says that more follow."""
    out = bytearray()
    while v >= 128:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def vbytes(values) -> bytes:
    return b"".join(map(vbyte, values))


class VByteReader:
    """Reads codes from bytes; strict: canonical and below a limit."""

    def __init__(self, data: bytes, at: int = 0, strict: bool = True, below: int = 1 << 128):
        self.data, self.at, self.strict, self.below = data, at, strict, below

    def __call__(self) -> int:
        v = shift = 0
        while True:
            if self.at >= len(self.data):
                raise FormatError("a VByte ends early")
            b = self.data[self.at]
            self.at += 1
            v |= (b & 127) << shift
            if b < 128:
                break
            shift += 7
            if shift > 126:
                raise FormatError("a VByte is too long")
        if self.strict and shift and not b:
            raise FormatError("a VByte isn't canonical")
        if v >= self.below:
            raise FormatError("a VByte is too large")
        return v


class BitWriter:
    """Bits from the high end of each byte on."""

    def __init__(self):
        self.parts: list[str] = []

    def put(self, value: int, width: int) -> None:
        if width:
            self.parts.append(format(value, f"0{width}b"))

    def bytes(self) -> bytes:
        bits = "".join(self.parts)
        return int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big") if bits else b""


class BitReader:
    def __init__(self, data: bytes):
        self.bits = bin(int.from_bytes(b"\1" + data, "big"))[3:]
        self.at = 0

    def get(self, width: int) -> int:
        if not width:
            return 0
        if self.at + width > len(self.bits):
            raise FormatError("the bits end early")
        self.at += width
        return int(self.bits[self.at - width : self.at], 2)

    def finish(self) -> None:
        """Only zero bits up to the byte's end may be left."""
        rest = self.bits[self.at :]
        if len(rest) > 7 or "1" in rest:
            raise FormatError("bits are left over")


def put_centred(out: BitWriter, v: int, span: int) -> None:
    """An offset below span; those in the middle get the short codes."""
    if span == 1:
        return
    width = (span - 1).bit_length()
    short = (1 << width) - span
    v = (v - (span - short) // 2) % span
    if v < short:
        out.put(v, width - 1)
    else:
        out.put(v + short, width)


def get_centred(bits: BitReader, span: int) -> int:
    if span == 1:
        return 0
    width = (span - 1).bit_length()
    short = (1 << width) - span
    v = bits.get(width - 1)
    if v >= short:
        v = (v << 1 | bits.get(1)) - short
    return (v + (span - short) // 2) % span


def _frames(first: int, last: int, low: int, high: int, at):
    """Pre-order frames of interpolative coding, left before right; at(mid, lo, span) gives the value at mid."""
    stack = [(first, last, low, high)]
    while stack:
        i, j, lo, hi = stack.pop()
        mid = i + (j - i) // 2
        start = lo + 1 + mid - i
        span = hi - 1 - (j - mid) - start + 1
        if span < 1:
            raise FormatError("values don't ascend")
        v = at(mid, start, span)
        if mid < j:
            stack.append((mid + 1, j, v, hi))
        if mid > i:
            stack.append((i, mid - 1, lo, v))


def interpolate(values: list[int], width: int) -> bytes:
    """Ascending values: both ends in `width` bits, the rest by interpolative coding."""
    out = BitWriter()
    out.put(values[0], width)
    if len(values) > 1:
        out.put(values[-1], width)
    if len(values) > 2:

        def at(mid, start, span):
            put_centred(out, values[mid] - start, span)
            return values[mid]

        _frames(1, len(values) - 2, values[0], values[-1], at)
    return out.bytes()


def interpolated(data: bytes, count: int, width: int) -> list[int]:
    bits = BitReader(data)
    out = [bits.get(width)]
    if count > 1:
        out += [0] * (count - 2) + [bits.get(width)]
        if out[0] >= out[-1]:
            raise FormatError("values don't ascend")
    if count > 2:

        def at(mid, start, span):
            out[mid] = start + get_centred(bits, span)
            return out[mid]

        _frames(1, count - 2, out[0], out[-1], at)
    bits.finish()
    return out


def put_gamma(out: BitWriter, v: int) -> None:
    out.put(0, v.bit_length() - 1)
    out.put(v, v.bit_length())


def get_gamma(bits: BitReader, most: int = 40) -> int:
    zeros = 0
    while not bits.get(1):
        zeros += 1
        if zeros > most:
            raise FormatError("a gamma code is too long")
    return 1 << zeros | bits.get(zeros)


def quantize(counts: dict[int, int], total: int = 1 << PROB_BITS) -> dict[int, int]:
    """Frequencies that sum to `total`, 1 at least, by largest remainder; ties to the higher symbol, excess from the first greatest."""
    symbols = sorted(counts)
    n = sum(counts.values())
    exact = [counts[s] / n * total for s in symbols]
    freq = [max(1, int(x)) for x in exact]
    order = sorted(range(len(symbols)), key=lambda k: (exact[k] - freq[k], k))
    short = total - sum(freq)
    for k in range(short):
        freq[order[-1 - k % len(order)]] += 1
    for _ in range(-short):
        freq[freq.index(max(freq))] -= 1
    return dict(zip(symbols, freq, strict=True))


def model_bytes(freq: dict[int, int]) -> bytes:
    symbols = sorted(freq)
    steps = [b - a for a, b in zip([0, *symbols], symbols, strict=False)]
    return vbytes([len(symbols), *(x for s, d in zip(symbols, steps, strict=True) for x in (d, freq[s] - 1))])


def read_model(read: VByteReader, alphabet: int) -> dict[int, int]:
    """A model; empty for an unused one."""
    n = read()
    if n > alphabet:
        raise FormatError("a model has too many symbols")
    out, s, total = {}, 0, 0
    for k in range(n):
        step = read()
        if k and not step:
            raise FormatError("a model repeats a symbol")
        s += step
        f = read() + 1
        total += f
        if s >= alphabet or total > 1 << PROB_BITS:
            raise FormatError("a model is out of range")
        out[s] = f
    if n and total != 1 << PROB_BITS:
        raise FormatError("a model's frequencies don't sum up")
    return out


class Model:
    """A model with its cumulative starts."""

    __slots__ = ("freq", "start", "symbols", "bounds")

    def __init__(self, freq: dict[int, int]):
        self.symbols = sorted(freq)
        self.bounds = list(accumulate((freq[s] for s in self.symbols), initial=0))
        self.freq = freq
        self.start = dict(zip(self.symbols, self.bounds, strict=False))


def rans_encode(pairs: list[tuple[Model, int]]) -> bytes:
    """Symbols of one block under their models; blocks start from a state of their own, so they encode in parallel."""
    state, out = RANS_LOW, bytearray()
    for model, s in reversed(pairs):
        f = model.freq[s]
        top = ((RANS_LOW >> PROB_BITS) << 8) * f
        while state >= top:
            out.append(state & 255)
            state >>= 8
        state = (state // f << PROB_BITS) + state % f + model.start[s]
    return state.to_bytes(4, "big") + bytes(reversed(out))


class RansDecoder:
    def __init__(self, data: bytes):
        if len(data) < 4:
            raise FormatError("a block is too short")
        self.state, self.data, self.at = int.from_bytes(data[:4], "big"), data, 4
        if not RANS_LOW <= self.state < RANS_LOW << 8:
            raise FormatError("a block begins with an impossible state")

    def get(self, model: Model) -> int:
        slot = self.state & ((1 << PROB_BITS) - 1)
        k = bisect_right(model.bounds, slot) - 1
        s = model.symbols[k]
        self.state = model.freq[s] * (self.state >> PROB_BITS) + slot - model.bounds[k]
        while self.state < RANS_LOW:
            if self.at >= len(self.data):
                raise FormatError("a block ends early")
            self.state = self.state << 8 | self.data[self.at]
            self.at += 1
        return s

    def finish(self) -> None:
        if self.state != RANS_LOW or self.at != len(self.data):
            raise FormatError("a block doesn't end cleanly")
