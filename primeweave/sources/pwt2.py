"""PWT2, the frequency-ordered prefix tree of prime paths: byte-aligned, and entropy-coded under context sets 1, 2 and 3.

A file is one stream whose contexts follow from what was read before, so a file is coded and decoded by one task; what can be
counted or ranked in parallel (orders, nodes, histograms) is in operators.tree.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np

from primeweave.functions.primes import small_primes
from primeweave.sources import formats
from primeweave.sources.codecs import BLOCK_SYMBOLS, U64, BitReader, BitWriter, Model, RansDecoder, VByteReader, get_gamma, model_bytes, put_gamma, quantize, rans_encode, read_model, vbyte
from primeweave.sources.formats import need

#: Fixed values of the format.
FULL, NAIVE, FREQUENCY, WHEEL, SIEVE = 1, 4, 8, 210, 100_000_000
COUNT_MOST, FIRST_MOST, ALPHABETS = 4095, 63, (64, 64, 4096, 2, 64)
COPRIME = [r for r in range(WHEEL) if math.gcd(r, WHEEL) == 1]


def _cap(v: int, most: int) -> int:
    return min(v.bit_length(), most)


def _bucket(c: int) -> int:
    return 0 if c <= 1 else 1 if c <= 3 else 2 if c <= 15 else 3


class Universe:
    """Positions of odd primes below the sieve limit, and of wheel numbers from it on."""

    def __init__(self, limit: int, most: int):
        self.limit = limit
        self.primes = small_primes(min(limit, most + 1))[1:]
        self.below = None if most < limit else len(self.primes)
        self.base = next(x for x in range(limit, limit + WHEEL) if math.gcd(x, WHEEL) == 1)

    @staticmethod
    def wheel(x: int) -> int:
        return len(COPRIME) * (x // WHEEL) + COPRIME.index(x % WHEEL)

    def position(self, p: int) -> int:
        if p < self.limit:
            k = int(np.searchsorted(self.primes, p))
            need(k < len(self.primes) and self.primes[k] == p, f"{p} isn't an odd prime")
            return k
        need(math.gcd(p, WHEEL) == 1, f"{p} isn't on the wheel")
        return self.below + self.wheel(p) - self.wheel(self.base)

    def at(self, position: int) -> int:
        if self.below is None or position < self.below:
            need(position < len(self.primes), "a position is out of range")
            return int(self.primes[position])
        w = position - self.below + self.wheel(self.base)
        return w // len(COPRIME) * WHEEL + COPRIME[w % len(COPRIME)]


class Contexts:
    """Keys (class, key) of the symbols, by what is known before each."""

    def __init__(self, kind: int, m: int, deepest: int):
        self.kind, self.m, self.deepest, self.ab = kind, m, deepest, m.bit_length() + 1
        self.flags = 82 + (deepest + 1) * 42
        self.ids = self.flags + deepest + deepest * 168

    def table(self, size: int, high: bool, before: int):
        key = _cap(size, 40) * 2 + high
        return (0, key) if self.kind == 1 else (0, key * 42 + _cap(before, 41))

    def count(self, depth: int, rank: int, vidx: int, product: int, first: bool, after: int):
        if self.kind == 1:
            return 0, 82 + depth * 42 + _cap(vidx, 41)
        k = (depth * self.ab + rank.bit_length()) * 82 + min(product.bit_length(), 81)
        return 1, (k * 2 + first) * 14 + _cap(after, 13)

    def flag(self, depth: int, c: int):
        return (0, self.flags + depth - 1) if self.kind == 1 else (3, (depth - 1) * 4 + _bucket(c))

    def gap(self, depth: int, c: int, i: int, before: int, parent: int, product: int):
        if self.kind == 1:
            return 0, self.flags + self.deepest + ((depth - 1) * 4 + _bucket(c)) * 42 + _cap(parent, 41)
        left = c - i
        k = (((depth - 1) * 4 + _bucket(c)) * 2 + (i == 0)) * self.ab + before.bit_length()
        return 4, ((k * self.ab + ((self.m - before) // left).bit_length()) * 14 + _cap(left, 13)) * 41 + min(product.bit_length(), 81) // 2

    def mantissa(self, depth: int, c: int, i: int, before: int, length: int):
        room = ((self.m - before) // (c - i)).bit_length()
        b = before + 1024 * (i == 0) if before < 1024 else 2048 + (((depth - 1) * 2 + (i == 0)) * self.ab + before.bit_length()) * self.ab + room
        return 5, b * 64 + length


def mantissa_bits(length: int) -> int:
    return length - 1 if length <= 12 else 4


class Order:
    """Ranks from 1 by how many paths hold a prime, ties to the larger prime; classes of equal counts."""

    def __init__(self, paths: list[list[int]]):
        count = Counter(p for path in paths for p in path)
        self.prime = [0, *sorted(count, key=lambda p: (-count[p], -p))]
        self.rank = {p: k for k, p in enumerate(self.prime)}
        sizes = Counter(count.values())
        self.classes = [sizes[c] for c in sorted(sizes, reverse=True)]
        self._index()

    def _index(self) -> None:
        place = {p: k + 1 for k, p in enumerate(sorted(self.prime[1:]))}
        self.vidx = [len(self.prime), *(place[p] for p in self.prime[1:])]

    @classmethod
    def of(cls, prime: list[int], classes: list[int]) -> Order:
        self = cls.__new__(cls)
        self.prime, self.classes = prime, classes
        self._index()
        return self

    def members(self) -> Iterator[tuple[int, list[int]]]:
        at = 1
        for size in self.classes:
            yield size, self.prime[at : at + size][::-1]
            at += size


def _tree(paths: list[list[int]]) -> tuple[bool, dict]:
    """Nested (terminal, children by rank)."""
    root: list = [False, {}]
    for path in paths:
        node = root
        for r in path:
            node = node[1].setdefault(r, [False, {}])
        need(not node[0], "a path occurs twice")
        node[0] = True
    return root


def _walk(node, order: Order, depth=0, rank=0, product=1, first=False, after=0):
    """Pre-order events: ("node", ...) and ("gap", ...)."""
    terminal, children = node
    c = len(children)
    yield "node", depth, rank, product, first, after, c, terminal
    before = rank
    for i, r in enumerate(sorted(children)):
        yield "gap", depth + 1, c, i, before, rank, product, r - before
        before = r
        yield from _walk(children[r], order, depth + 1, r, product * order.prime[r], i == 0, c - i - 1)


def encode(paths: list[list[int]], n_targets: bytes, full: bool = False, kind: int | None = 3, limit: int = SIEVE) -> bytes:
    """kind: a context set, or None for the byte-aligned variant."""
    need(bool(paths), "no paths")
    order = Order(paths)
    root = _tree([sorted(order.rank[p] for p in path) for path in paths])
    m, deepest = len(order.prime) - 1, max(map(len, paths))
    classes = b"".join(map(vbyte, order.classes))
    if kind is None:
        out, total = [], m
        for _, members in order.members():
            out += [vbyte(b - a) for a, b in zip([0, *members], members, strict=False)]
        for e in _walk(root, order):
            out.append(vbyte(2 * e[6] + e[7]) if e[0] == "node" else vbyte(e[7]))
        total, tables, blocks, raw, n_blocks = len(out), b"", b"".join(out), b"", 0
    else:
        tables, blocks, raw, total = _coded(order, root, Contexts(kind, m, deepest), Universe(limit, max(order.prime)))
        n_blocks = -(-total // BLOCK_SYMBOLS)
    offsets, at = [], 160
    for part in (classes, tables, blocks, raw):
        offsets += [at, len(part)]
        at += len(part)
    flags = FREQUENCY | (FULL if full else 0) | (NAIVE if kind is None else 0)
    head = formats.PWT2 + struct.pack("<HHQBBHI", 1, flags, len(paths), deepest, kind or 1, 0, WHEEL)
    head += struct.pack("<QQQ8QQIIQQQQ", limit, m, len(order.classes), *offsets, n_blocks, 0 if kind is None else BLOCK_SYMBOLS, 0, total, m, at, 0)
    data = head + classes + tables + blocks + raw
    return data + hashlib.sha256(data).digest() + n_targets


def _coded(order: Order, root, ctx: Contexts, universe: Universe) -> tuple[bytes, bytes, bytes, int]:
    kept = _kept_mantissas(order, root, ctx) if ctx.kind == 3 else {}
    symbols, raw = [], BitWriter()
    for size, members in order.members():
        before = None
        for p in members:
            at = universe.position(p)
            g = at + 1 if before is None else at - universe.position(before)
            symbols.append((ctx.table(size, before is not None and before >= universe.limit, 0 if before is None else universe.position(before)), g.bit_length()))
            raw.put(g - (1 << g.bit_length() - 1), g.bit_length() - 1)
            before = p
    for e in _walk(root, order):
        if e[0] == "node":
            _, depth, rank, product, first, after, c, terminal = e
            key = ctx.count(depth, rank, order.vidx[rank], product, first, after)
            if ctx.kind == 1:
                symbols.append((key, min(c, COUNT_MOST)))
            else:
                symbols.append((key, min(c, FIRST_MOST)))
                if c >= FIRST_MOST:
                    symbols.append(((2, depth), min(c, COUNT_MOST)))
            if c >= COUNT_MOST:
                put_gamma(raw, c - COUNT_MOST + 1)
            if c and depth:
                symbols.append((ctx.flag(depth, c), int(terminal)))
        else:
            _, depth, c, i, before, parent, product, g = e
            length = g.bit_length()
            symbols.append((ctx.gap(depth, c, i, before, parent, product), length))
            low = length - 1
            if length >= 2 and kept:
                key = ctx.mantissa(depth, c, i, before, length)
                if key in kept:
                    low -= mantissa_bits(length)
                    symbols.append((key, g - (1 << length - 1) >> low))
            raw.put(g & (1 << low) - 1, low)
    counts: dict[tuple, Counter] = {}
    for key, s in symbols:
        counts.setdefault(key, Counter())[s] += 1
    freq = {key: quantize(c) for key, c in counts.items()}
    if ctx.kind == 1:
        tables = b"".join(model_bytes(freq[0, k]) if (0, k) in freq else b"\0" for k in range(ctx.ids))
    else:
        parts = []
        for cls in range(5 + (ctx.kind == 3)):
            keys = sorted(k for c, k in freq if c == cls)
            parts.append(vbyte(len(keys)))
            parts += [vbyte(b - a) + model_bytes(freq[cls, b]) for a, b in zip([0, *keys], keys, strict=False)]
        tables = b"".join(parts)
    models = {key: Model(f) for key, f in freq.items()}
    blocks = []
    for at in range(0, len(symbols), BLOCK_SYMBOLS):
        part = symbols[at : at + BLOCK_SYMBOLS]
        data = rans_encode([(models[key], s) for key, s in part])
        blocks.append(struct.pack("<II", len(part), len(data)) + data)
    return tables, b"".join(blocks), raw.bytes(), len(symbols)


def _kept_mantissas(order: Order, root, ctx: Contexts) -> set:
    """Keys whose model pays for itself."""
    counts: dict[tuple, Counter] = {}
    for e in _walk(root, order):
        if e[0] == "gap":
            _, depth, c, i, before, _, _, g = e
            length = g.bit_length()
            if length >= 2:
                v = g - (1 << length - 1) >> length - 1 - mantissa_bits(length)
                counts.setdefault(ctx.mantissa(depth, c, i, before, length), Counter())[v] += 1
    out = set()
    for key, c in counts.items():
        freq = quantize(c)
        cost = sum(c[s] * (16 - math.log2(freq[s])) for s in sorted(c))
        if mantissa_bits(key[1] % 64) * sum(c.values()) - cost - 8 * (len(model_bytes(freq)) + 3) > 0:
            out.add(key)
    return out


def value_of(primes: list[int], full: bool) -> int:
    """n of a path: the product, or d times the inverse of d modulo lam(d)."""
    d = math.prod(primes)
    need(d < 1 << 128, "a product is too large")
    if full:
        return d
    lam = math.lcm(*(p - 1 for p in primes))
    need(lam < 1 << 127 and math.gcd(d, lam) == 1, "a divisor has no inverse")
    n = d * (pow(d, -1, lam) if lam > 1 else 0)
    need(n < 1 << 128, "a value is too large")
    return n


def decode(data: bytes) -> Iterator[list[int]]:
    """Paths in tree order, primes ascending within each; checks the file on the way."""
    need(len(data) >= 248 and data[:4] == formats.PWT2, "not a tree file")
    version, flags, n, deepest, kind, zero, wheel = struct.unpack_from("<HHQBBHI", data, 4)
    limit, m, n_classes, *rest = struct.unpack_from("<QQQ8QQIIQQQQ", data, 24)
    offsets, (n_blocks, block, zero2, total, table_symbols, footer, zero3) = rest[:8], rest[8:]
    naive, full = bool(flags & NAIVE), bool(flags & FULL)
    need(version == 1 and flags & ~(FULL | NAIVE) == FREQUENCY and kind in (1, 2, 3) and not (naive and kind > 1) and not (zero or zero2 or zero3), "the header is wrong")
    need(wheel == WHEEL and WHEEL < limit <= 1 << 34 and 1 <= m < 1 << 32 and 1 <= n_classes <= m and table_symbols == m and 1 <= deepest <= 30 and 1 <= n <= total, "the header is out of range")
    need(block == (0 if naive else BLOCK_SYMBOLS) and n_blocks == (0 if naive else -(-total // BLOCK_SYMBOLS)), "the block figures are wrong")
    at = 160
    for off, size in zip(offsets[::2], offsets[1::2], strict=True):
        need(off == at, "the sections don't tile the file")
        at += size
    need(at == footer and footer + 88 == len(data), "the sections don't tile the file")
    need(hashlib.sha256(data[:footer]).digest() == data[footer : footer + 32], "the payload's hash differs")
    need(data[-8:] == n.to_bytes(8, "little"), "the count differs")
    sections = [data[o : o + s] for o, s in zip(offsets[::2], offsets[1::2], strict=True)]
    read = VByteReader(sections[0], below=U64)
    classes = [read() for _ in range(n_classes)]
    need(read.at == len(sections[0]) and all(classes) and sum(classes) == m, "the class sizes are wrong")
    reader = _Naive(sections) if naive else _Coded(sections, Contexts(kind, m, deepest), limit, total, n_blocks)
    prime = [0]
    for size in classes:
        members = reader.members(size)
        need(all(a < b for a, b in zip(members, members[1:], strict=False)) and all(p >= 3 and p & 1 and p < 1 << 40 for p in members), "a class is malformed")
        prime += members[::-1]
    need(len(set(prime)) == len(prime), "a prime occurs twice")
    low = [p for p in prime[1:] if p < limit]
    need(not low or bool(np.isin(low, small_primes(max(low) + 1)).all()), "a member isn't prime")
    order = Order.of(prime, classes)
    found, deep = 0, 0
    # a frame: depth, rank, product, children, next child, last rank, path
    c, terminal = reader.node(0, 0, order, 1, False, 0)
    need(not terminal, "the root is a path")
    stack = [[0, 0, 1, c, 0, 0]]
    while stack:
        depth, rank, product, c, i, before = frame = stack[-1]
        if i == c:
            stack.pop()
            continue
        g = reader.gap(depth + 1, c, i, before, rank, product)
        r = before + g
        need(g >= 1 and r <= m and depth < deepest, "a rank is out of range")
        frame[4:] = [i + 1, r]
        child = product * prime[r]
        cc, terminal = reader.node(depth + 1, r, order, child, i == 0, c - i - 1)
        stack.append([depth + 1, r, child, cc, 0, r])
        if terminal:
            found, deep = found + 1, max(deep, depth + 1)
            need(found <= n, "there are more paths than records")
            yield sorted(prime[f[1]] for f in stack[1:])
    need(found == n and deep == deepest, "the records or the depth differ")
    reader.finish(total)


class _Naive:
    def __init__(self, sections):
        need(not sections[1] and not sections[3], "sections should be empty")
        self.read, self.count = VByteReader(sections[2], below=U64), 0

    def _next(self) -> int:
        self.count += 1
        return self.read()

    def members(self, size: int) -> list[int]:
        out = [self._next()]
        for _ in range(size - 1):
            out.append(out[-1] + self._next())
        return out

    def node(self, depth, rank, order, product, first, after):
        v = self._next()
        need(v > 0 or not depth, "a leaf isn't a path")
        return v >> 1, v & 1

    def gap(self, *_) -> int:
        return self._next()

    def finish(self, total: int) -> None:
        need(self.read.at == len(self.read.data) and self.count == total, "symbols are left over")


class _Coded:
    def __init__(self, sections, ctx: Contexts, limit: int, total: int, n_blocks: int):
        self.ctx, self.raw, self.blocks, self.at, self.left, self.coder, self.count = ctx, BitReader(sections[3]), sections[2], 0, 0, None, 0
        self.models: dict[tuple, Model] = {}
        self.universe = None
        self.limit = limit
        read = VByteReader(sections[1], below=U64)
        if ctx.kind == 1:
            for k in range(ctx.ids):
                f = read_model(read, 64 if k < 82 else 4096 if k < ctx.flags else 2 if k < ctx.flags + ctx.deepest else 64)
                if f:
                    self.models[0, k] = Model(f)
        else:
            for cls in range(5 + (ctx.kind == 3)):
                key = 0
                for k in range(read()):
                    step = read()
                    need(step > 0 or not k, "keys don't ascend")
                    key += step
                    need(key < U64 - 1 and (cls < 5 or key % 64 >= 2), "a key is out of range")
                    f = read_model(read, ALPHABETS[cls] if cls < 5 else 1 << mantissa_bits(key % 64))
                    need(bool(f), "a model is empty")
                    self.models[cls, key] = Model(f)
        need(read.at == len(sections[1]), "bytes are left over in the tables")

    def _symbol(self, key) -> int:
        need(key in self.models, "a symbol has no model")
        if not self.left:
            self._open()
        self.left -= 1
        self.count += 1
        return self.coder.get(self.models[key])

    def _open(self) -> None:
        if self.coder:
            self.coder.finish()
        need(self.at + 8 <= len(self.blocks), "a block is missing")
        self.left, size = struct.unpack_from("<II", self.blocks, self.at)
        need(0 < self.left <= BLOCK_SYMBOLS and self.at + 8 + size <= len(self.blocks), "a block is out of range")
        self.coder = RansDecoder(self.blocks[self.at + 8 : self.at + 8 + size])
        self.at += 8 + size

    def _value(self, length: int) -> int:
        need(1 <= length <= 63, "a gap's length is out of range")
        return 1 << length - 1 | self.raw.get(length - 1)

    def members(self, size: int) -> list[int]:
        if self.universe is None:
            self.universe = Universe(self.limit, self.limit)
        out, before, position = [], None, -1
        for _ in range(size):
            key = self.ctx.table(size, before is not None and before >= self.limit, max(position, 0) if before is not None else 0)
            position += self._value(self._symbol(key))
            before = self.universe.at(position)
            out.append(before)
        return out

    def node(self, depth, rank, order, product, first, after):
        key = self.ctx.count(depth, rank, order.vidx[rank], product, first, after)
        c = self._symbol(key)
        if self.ctx.kind > 1 and c >= FIRST_MOST:
            c = self._symbol((2, depth))
            need(c >= FIRST_MOST, "a tail is too small")
        if c >= COUNT_MOST:
            c = get_gamma(self.raw) + COUNT_MOST - 1
        return c, (self._symbol(self.ctx.flag(depth, c)) if c and depth else not c and depth > 0)

    def gap(self, depth, c, i, before, parent, product) -> int:
        length = self._symbol(self.ctx.gap(depth, c, i, before, parent, product))
        need(1 <= length <= 63, "a gap's length is out of range")
        if self.ctx.kind == 3 and length >= 2:
            key = self.ctx.mantissa(depth, c, i, before, length)
            if key in self.models:
                vb = mantissa_bits(length)
                return (1 << vb | self._symbol(key)) << length - 1 - vb | self.raw.get(length - 1 - vb)
        return self._value(length)

    def finish(self, total: int) -> None:
        need(self.coder is not None and not self.left and self.at == len(self.blocks) and self.count == total, "symbols are left over")
        self.coder.finish()
        self.raw.finish()
