"""Lossless WebP columns: text bytes as 8-bit samples, a VP8L encoder and a full VP8L decoder.

The decoder follows RFC 9649: prefix codes (simple and normal, with meta groups), LZ77
back-references with the two-dimensional distance codes, the colour cache, and the inverse
predictor, cross-colour, subtract-green and palette transforms. Images without meta groups and cache
are decoded at once by numpy: the next symbol is worked out for every bit, the chain of symbols is
followed by doubled jumps, and back-references are resolved by following sources to literals. Any
other image is decoded symbol by symbol.

The encoder writes prefix codes of mixed lengths and back-references. An image of at most 256 colours
(as texts are, one byte a pixel) goes through the palette; any other through predictor, cross-colour
and subtract-green transforms, with a colour cache on request.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.llm.common import tidy
from trialforge.llm.token_files import code_lengths

WIDTH = 64
MAX_SIDE = 1 << 14

# Fixed values of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]

# Fixed values of the format: (x, y) of the distance codes 1 to 120.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]

_NEAR = np.array(NEAR)
_EIGHT = np.arange(8, dtype=np.uint32)


class Bits:
    """Least significant bit first, over one big number for the headers and windows for symbols."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        return (int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def peek_long(self, n: int) -> int:
        return (int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end + 32:
            raise ValueError("image data ended early")
        return value


#: 15 bits in reverse order.
_REVERSE = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], np.uint16)
#: The same for the codes of code lengths, which have 7 bits at most.
_REVERSED = _REVERSE[:128].tolist()


@lru_cache(maxsize=16)
def _places(longest: int) -> np.ndarray:
    """All numbers of `longest` bits with their bits in reverse order."""
    return (_REVERSE[: 1 << longest] >> (15 - longest)).astype(np.int64)


class PrefixCode:
    """A canonical code of at most 15 bits: a table over the next `longest` bits, symbol << 4 | length."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.only = int(symbols[0]) if len(symbols) == 1 else None
        self.longest = 0 if self.only is not None else int(lengths.max(initial=0))
        if self.only is not None:
            self.table = np.array([self.only << 4], np.int32)
            return
        order = lengths.argsort(kind="stable")  # symbols come in order
        size = lengths[order]
        spans = 1 << (self.longest - size)
        if int(spans.sum()) != 1 << self.longest or not len(symbols):
            raise ValueError("incomplete prefix code")
        by_code = (symbols[order] << 4 | size).astype(np.int32).repeat(spans)
        self.table = by_code.take(_places(self.longest), mode="clip")

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        found = int(self.table[bits.peek(self.longest)])
        bits.at += found & 15
        return found >> 4


@lru_cache(maxsize=512)
def _single(symbol: int) -> PrefixCode:
    return PrefixCode(np.array([symbol]), np.zeros(1, np.int64))


def _table_of_lengths(steps: list[int]) -> tuple[list[int], int]:
    """The table of a code of few symbols (symbol << 4 | length) and its mask, as `PrefixCode` makes it."""
    used = sorted((n, s) for s, n in enumerate(steps) if n)
    if len(used) == 1:
        return [used[0][1] << 4], 0
    longest = used[-1][0] if used else 0
    table, code = [0] * (1 << longest), 0
    for n, s in used:
        if code >= 1 << longest:
            raise ValueError("incomplete prefix code")
        first = _REVERSED[code] >> (15 - longest)
        table[first :: 1 << n] = [s << 4 | n] * (1 << (longest - n))
        code += 1 << (longest - n)
    if not used or code != 1 << longest:
        raise ValueError("incomplete prefix code")
    return table, (1 << longest) - 1


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    if (short := bits.peek(11)) & 7 == 0b101:
        bits.read(11)
        return _single(short >> 3)
    if short & 1:
        head = bits.read(3)
        symbols = [bits.read(8 if head & 4 else 1)] + ([bits.read(8)] if head & 2 else [])
        if len(symbols) == 1 or symbols[0] == symbols[1]:
            return _single(symbols[0])
        return PrefixCode(np.sort(symbols), np.ones(2, np.int64))
    bits.read(5)
    steps = [0] * 19
    stored = 4 + (short >> 1 & 15)
    held = bits.peek_long(3 * stored)
    bits.at += 3 * stored
    for s in LENGTH_ORDER[:stored]:
        steps[s] = held & 7
        held >>= 3
    table, mask = _table_of_lengths(steps)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    # a window over all the lengths: at most 14 bits each
    window = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 * min(left, alphabet) + 8], "little") >> (bits.at & 7)
    lengths: list[int] = []
    last, took = 8, 0
    while len(lengths) < alphabet and left:
        left -= 1
        found = table[window & mask]
        n = found & 15
        found >>= 4
        if found < 16:
            lengths.append(found)
            last = found or last
        else:
            more, least, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[found - 16]
            lengths += [value] * (least + (window >> n & ((1 << more) - 1)))
            n += more
        window >>= n
        took += n
    bits.at += took
    if bits.at > bits.end:
        raise ValueError("image data ended early")
    if len(lengths) > alphabet:
        raise ValueError("too many code lengths")
    all_lengths = np.array(lengths, np.int64)
    used = all_lengths.nonzero()[0]
    return PrefixCode(used, all_lengths[used])


def _extra(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    n = (code - 2) >> 1
    return ((2 + (code & 1)) << n) + bits.read(n) + 1


def _distance(code: np.ndarray | int, width: int):
    """How far back a distance code points, in pixels."""
    near = np.maximum(1, _NEAR[:, 0] + _NEAR[:, 1] * width)
    return np.where(code > 120, code - 120, near[np.minimum(code, 120) - 1])


def _green_only(bits: Bits, group: list[PrefixCode], n: int) -> np.ndarray | None:
    """A small image of literals whose other channels are constant, or None."""
    if any(c.longest for c in group[1:4]):
        return None
    table, mask = group[0].table.tolist(), (1 << group[0].longest) - 1
    window, took, out = bits.peek_long(n * group[0].longest + 1), 0, []
    for _ in range(n):
        found = table[window & mask]
        window >>= found & 15
        took += found & 15
        out.append(found >> 4)
    if max(out) > 255:
        return None
    bits.at += took
    if bits.at > bits.end:
        raise ValueError("image data ended early")
    return np.array(out, np.uint32) << np.uint32(8) | np.uint32(group[1].only << 16 | group[2].only | group[3].only << 24)


def _at_once(bits: Bits, group: list[PrefixCode], n: int, width: int) -> np.ndarray:
    """All n pixels under one group of codes, without a colour cache."""
    if n <= 256 and (found := _green_only(bits, group, n)) is not None:
        return found
    first = bits.at >> 3
    data = bits.data[first:] + bytes(12)
    end = bits.end - 8 * first
    # the next 25 bits and more at every bit; beyond the end, zeros
    windows = (np.ndarray((len(data) - 4,), "<u4", data, 0, (1,))[:, None] >> _EIGHT).reshape(-1)
    size = len(windows) - 64
    look = lambda code, at: code.table[windows[at] & np.uint32((1 << code.longest) - 1)]
    green = group[0].table.take((windows[:size] & np.uint32((1 << group[0].longest) - 1)).view(np.int32), mode="clip") if group[0].longest else np.full(size, group[0].table[0])
    after = np.arange(size, dtype=np.int32) + (green & 15)
    copies = (green >= 256 << 4).nonzero()[0]
    wide = [c for c in group[1:4] if c.longest]
    if wide:
        on = after.copy()
        for c in wide:
            on = np.minimum(on + (look(c, np.minimum(on, size)) & 15), size)
    length, distance = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(copies):
        at = after[copies].astype(np.int64)
        symbol = (green[copies] >> 4) - 256

        def extra(symbol: np.ndarray) -> np.ndarray:
            nonlocal at
            more = np.where(symbol < 4, 0, (symbol - 2) >> 1)
            value = np.where(symbol < 4, symbol, (2 + (symbol & 1)) << more)
            at = np.minimum(at, size)
            rest = windows[at].astype(np.int64)
            at = at + more
            return value + (rest & ((1 << more) - 1)) + 1

        length = extra(symbol)
        found = look(group[4], np.minimum(at, size))
        at = at + (found & 15)
        distance = extra(found >> 4)
        jump = np.minimum(at, size).astype(np.int32)
    if wide:
        after = on
    if len(copies):
        after[copies] = jump
    after = np.minimum(after, size).astype(np.int32)
    # the chain of symbols: every eighth by one jump, the others by shorter jumps from it
    after = np.append(after, np.int32(size))
    two = after.take(after, mode="clip")
    four = two.take(two, mode="clip")
    eight = memoryview(four.take(four, mode="clip"))
    chain, at = [], bits.at & 7
    for _ in range(n // 8 + 1):
        chain.append(at)
        at = eight[at]
        if at >= size:
            break
    runs = np.empty((len(chain), 8), np.int32)
    runs[:, 0] = chain
    for jump, step in ((four, 4), (two, 2), (after, 1)):
        runs[:, step :: 2 * step] = jump[runs[:, :: 2 * step]]
    at = runs.reshape(-1)
    at = at[: at.searchsorted(size)]
    symbol = green[at] >> 4
    is_copy = symbol >= 256
    takes = np.ones(len(at), np.int64)
    if is_copy.any():
        which = copies.searchsorted(at[is_copy])
        takes[is_copy] = length[which]
    upto = takes.cumsum()
    last = int(upto.searchsorted(n))
    if last >= len(at) or upto[last] != n or after[at[last]] > end:
        raise ValueError("image data ended early")
    at, symbol, is_copy, upto = at[: last + 1], symbol[: last + 1], is_copy[: last + 1], upto[: last + 1]
    if symbol.max(initial=0) >= 280:
        raise ValueError("no such code")
    pixels = (symbol << 8).astype(np.uint32)
    pixels |= np.uint32(sum(c.only << shift for c, shift in zip(group[1:4], (16, 0, 24)) if not c.longest))
    on = at + (green[at] & 15) if wide else at
    for c, shift in zip(group[1:4], (16, 0, 24)):
        if c.longest:
            found = look(c, np.minimum(on, size))
            pixels |= (found >> 4).astype(np.uint32) << np.uint32(shift)
            on = on + (found & 15)
    bits.at = 8 * first + int(after[at[-1]])
    if not is_copy.any():
        return pixels
    takes = takes[: last + 1]
    out = pixels.repeat(takes)
    which = which[: int(is_copy.sum())]
    long, back = length[which], _distance(distance[which], width)
    begin = (upto - takes)[is_copy]
    if (back > begin).any():
        raise ValueError("back-reference out of the image")
    place = (begin - long.cumsum() + long).repeat(long) + np.arange(int(long.sum()))
    source = np.arange(n)
    source[place] = place - back.repeat(long)
    while len(place):
        source[place] = source[source[place]]
        place = place[source[source[place]] != source[place]]
    return out[source]


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, meta, meta_bits, meta_width = 1, None, 0, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta_width = -(-width >> meta_bits)
        image = read_pixels(bits, meta_width, -(-height >> meta_bits), False)
        meta = ((image >> 8) & 0xFFFF).tolist()
        groups = max(meta) + 1
    cache_size = (1 << cache_bits) if cache_bits else 0
    codes = [[read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    if not cache_bits and meta is None:
        return _at_once(bits, codes[0], n, width)
    return _one_by_one(bits, codes, n, width, cache_bits, meta, meta_bits, meta_width)


def _one_by_one(bits: Bits, codes: list[list[PrefixCode]], n: int, width: int, cache_bits: int = 0, meta: list[int] | None = None, meta_bits: int = 0, meta_width: int = 0) -> np.ndarray:
    """All n pixels, symbol by symbol, with meta groups and the colour cache."""
    cache_size = (1 << cache_bits) if cache_bits else 0
    out, cache, cached = [0] * n, [0] * max(1, cache_size), 0
    at, group = 0, codes[0]

    def keep(upto: int) -> None:
        nonlocal cached
        if cache_bits:
            for argb in out[cached:upto]:
                cache[(0x1E35A7BD * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb
        cached = upto

    while at < n:
        if meta is not None:
            group = codes[meta[(at // width >> meta_bits) * meta_width + (at % width >> meta_bits)]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (group[k].read(bits) for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length, code = _extra(bits, s - 256), group[4].read(bits)
            distance = int(_distance(_extra(bits, code), width))
            if distance > at or at + length > n:
                raise ValueError("back-reference out of the image")
            for k in range(at, at + length):
                out[k] = out[k - distance]
            at += length
        else:
            keep(at)
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) as blue, green, red, alpha."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def undo_predictor(residual: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = residual.shape
    delta = _channels(residual).astype(np.int32)
    out = np.zeros_like(delta)
    half = lambda a, b: (a + b) >> 1
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = out[y, x - 1] if x else np.array([0, 0, 0, 255])
            elif x == 0:
                guess = out[y - 1, x]
            else:
                left, top, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
                right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                mode = modes[y >> size_bits, x >> size_bits]
                if mode == 11:
                    # distance of left's own estimate is that of top from the corner, and so on
                    guess = left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
                elif mode == 12:
                    guess = np.clip(left + top - corner, 0, 255)
                elif mode == 13:
                    mean = half(left, top)
                    step = mean - corner
                    guess = np.clip(mean + np.sign(step) * (np.abs(step) >> 1), 0, 255)
                else:
                    guess = {
                        0: lambda: np.array([0, 0, 0, 255]), 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
                        5: lambda: half(half(left, right), top), 6: lambda: half(left, corner), 7: lambda: half(left, top),
                        8: lambda: half(corner, top), 9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right)),
                    }.get(mode, lambda: np.array([0, 0, 0, 255]))()
            out[y, x] = (delta[y, x] + guess) & 255
    return out.astype(np.uint8).view("<u4").reshape(height, width).astype(np.uint32)


def undo_cross_colour(argb: np.ndarray, elements: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = argb.shape
    by = _channels(elements)[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits].view(np.int8).astype(np.int32)
    c = _channels(argb).astype(np.int32)
    signed = lambda a: a.astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(c[..., 1])
    red = (c[..., 2] + ((by[..., 0] * green) >> 5)) & 255
    blue = (c[..., 0] + ((by[..., 1] * green) >> 5) + ((by[..., 2] * signed(red)) >> 5)) & 255
    out = np.stack([blue, c[..., 1], red, c[..., 3]], axis=-1).astype(np.uint8)
    return out.view("<u4").reshape(height, width).astype(np.uint32)


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb).copy()
    c[..., 0] += c[..., 1]
    c[..., 2] += c[..., 1]
    return c.view("<u4").reshape(argb.shape).astype(np.uint32)


def undo_palette(argb: np.ndarray, palette: np.ndarray, width: int, width_bits: int) -> np.ndarray:
    index = (argb >> 8) & 255
    if width_bits:
        each = 8 >> width_bits
        x = np.arange(width)
        index = (index[:, x >> width_bits] >> ((x & ((1 << width_bits) - 1)) * each)) & ((1 << each) - 1)
    return np.concatenate([palette, np.zeros(256, np.uint32)])[index]


def decode_webp(data: bytes) -> np.ndarray:
    """ARGB pixels (height, width) of one lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("no lossless WebP")
    bits = Bits(data[21 : 20 + struct.unpack_from("<I", data, 16)[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            size_bits = bits.read(3) + 2
            block_width, block_height = -(-now >> size_bits), -(-height >> size_bits)
            image = read_pixels(bits, block_width, block_height, False).reshape(block_height, block_width)
            if kind == 0:
                undo.append(lambda a, m=(image >> 8) & 15, b=size_bits: undo_predictor(a, m, b))
            else:
                undo.append(lambda a, e=image, b=size_bits: undo_cross_colour(a, e, b))
        elif kind == 2:
            undo.append(undo_subtract_green)
        else:
            n = bits.read(8) + 1
            raw = _channels(read_pixels(bits, n, 1, False))
            palette = np.ascontiguousarray(np.cumsum(raw, axis=0, dtype=np.uint8)).view("<u4").reshape(n).astype(np.uint32)
            width_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda a, p=palette, w=now, b=width_bits: undo_palette(a, p, w, b))
            now = -(-now >> width_bits)
    argb = read_pixels(bits, now, height, True).reshape(height, now)
    for step in reversed(undo):
        argb = step(argb)
    return argb


class BitWriter:
    def __init__(self) -> None:
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def _lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Huffman code lengths of the symbols with counts; a longer code than the limit is made anew by package-merge."""
    used = counts.nonzero()[0]
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    # two queues: symbols by weight, and sums, which come in order; a weight beyond all ends either
    leaves = sorted(range(len(used)), key=weights.__getitem__)
    n, end = len(used), sum(weights) + 1
    single, sums = [weights[k] for k in leaves] + [end], [end] * n
    parent = [0] * (2 * n - 1)
    i = j = 0
    for k in range(n - 1):
        if single[i] <= sums[j]:
            pair = single[i]
            parent[i] = n + k
            i += 1
        else:
            pair = sums[j]
            parent[n + j] = n + k
            j += 1
        if single[i] <= sums[j]:
            pair += single[i]
            parent[i] = n + k
            i += 1
        else:
            pair += sums[j]
            parent[n + j] = n + k
            j += 1
        sums[k] = pair
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    if max(depth) > limit:
        return code_lengths(counts, limit).astype(np.int64)
    out[used[leaves]] = depth[: len(used)]
    return out


def _put_code(head: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write the best code for the counts; lengths and reversed codes of its symbols."""
    used = counts.nonzero()[0]
    reversed_codes = np.zeros(len(counts), np.uint64)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        head.put(1 | (len(symbols) - 1) << 1 | 1 << 2, 3)
        for s in symbols:
            head.put(s, 8)
        size = np.zeros(len(counts), np.int64)
        if len(symbols) == 2:
            size[used] = 1
            reversed_codes[used[1]] = 1
        return size, reversed_codes
    size = _lengths(counts, 15)
    order = used[size[used].argsort(kind="stable")]
    spans = 1 << (15 - size[order])
    reversed_codes[order] = _REVERSE[spans.cumsum() - spans]
    # lengths, with runs of zeros, up to the last symbol
    tokens: list[tuple[int, int, int]] = []
    at, listed = 0, size.tolist()
    for s in used.tolist():
        gap = s - at
        while gap >= 11:
            n = min(gap, 138)
            tokens.append((18, n - 11, 7))
            gap -= n
        if gap >= 3:
            tokens.append((17, gap - 3, 3))
            gap = 0
        tokens += [(0, 0, 0)] * gap
        tokens.append((listed[s], 0, 0))
        at = s + 1
    tokens += [(0, 0, 0)] * (2 - len(tokens))
    # the code of the lengths: of k or k - 1 bits, the shorter ones for the most frequent
    often = Counter(t[0] for t in tokens)
    if len(often) == 1:
        often[int(0 in often)] = 0
    ranked = sorted(often, key=lambda s: (-often[s], s))
    k = (len(ranked) - 1).bit_length()
    steps = dict(zip(ranked, [k - 1] * ((1 << k) - len(ranked)) + [k] * len(ranked)))
    stored = max(4, max(place for place, s in enumerate(LENGTH_ORDER) if s in steps) + 1)
    head.put((stored - 4) << 1, 5)
    head.put(sum(steps.get(s, 0) << (3 * place) for place, s in enumerate(LENGTH_ORDER[:stored])), 3 * stored)
    # `more` bits tell the number of lengths that follow
    more = max(2, (len(tokens) - 2).bit_length() + (len(tokens) - 2).bit_length() % 2)
    head.put(1 | (more - 2) // 2 << 1 | (len(tokens) - 2) << 4, 4 + more)
    code, last, codes = 0, 0, {}
    for n, s in sorted((n, s) for s, n in steps.items()):
        code <<= n - last
        codes[s], last = int(_REVERSE[code << (15 - n)]), n
        code += 1
    value = bits = 0
    for s, extra, n in tokens:
        value |= (codes[s] | extra << steps[s]) << bits
        bits += steps[s] + n
    head.put(value, bits)
    # one symbol takes no bits
    return (size if len(used) > 1 else np.zeros_like(size)), reversed_codes


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number of lengths and distances from 1."""
    if len(values) and values.max() < _PREFIXES.shape[1]:
        return tuple(_PREFIXES.take(values, axis=1))
    return _prefix_of(values)


def _prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = values - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    more = np.where(x < 4, 0, high - 1)
    symbol = np.where(x < 4, x, 2 * high + ((x >> np.maximum(more, 0)) & 1))
    return symbol, x & ((1 << more) - 1), more


#: What small values have, by value from 0, which does not occur.
_PREFIXES = np.stack(_prefix_of(np.maximum(1, np.arange(1 << 13))))


GRAM, LONGEST_COPY = 8, 4096


def _green_alone(argb: np.ndarray) -> bool:
    """Whether all other channels are constant."""
    return not ((argb ^ argb.reshape(-1)[0]) & np.uint32(0xFFFF00FF)).any()


def back_references(pixels: np.ndarray, exact: bool | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and distance of copies that do not overlap; a repeat counts from eight pixels on.

    A place is compared with the one before it of the same 16-bit hash of eight pixels; neighbours
    of one distance are one copy, cut where an earlier copy covers it. Eight pixels that differ in
    green only (`exact`; None: not known) are one 64-bit number, which is compared itself.
    """
    none = np.zeros(0, np.int64)
    n = len(pixels) - GRAM + 1
    if n < 2:
        return none, none, none
    if exact is None:
        exact = _green_alone(pixels)
    if exact:
        green = (pixels >> np.uint32(8)).astype(np.uint8)
        key = np.ndarray((n,), "<u8", green, 0, (1,)).astype(np.uint64)
        h = key ^ key >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    else:
        h = np.zeros(n, np.uint64)
        for k in range(GRAM):
            h = h * np.uint64(0x9E3779B97F4A7C15) + pixels[k : k + n]
        h ^= h >> np.uint64(32)
        key = h
    h = h * np.uint64(0xD6E8FEB86659FD93)
    order = (h >> np.uint64(48)).astype(np.uint16).argsort(kind="stable")
    sorted_key = key[order]
    same = (sorted_key[1:] == sorted_key[:-1]).nonzero()[0]
    if not len(same):
        return none, none, none
    distance = np.zeros(n + 1, np.int64)
    at, before = order[same + 1], order[same]
    distance[at] = at - before
    if not exact:
        # a hash is no proof: each place of a run has its eight pixels compared
        good = np.ones(len(at), bool)
        for k in range(GRAM):
            good &= pixels[at + k] == pixels[before + k]
        distance[at[~good]] = 0
    changed = np.ones(n + 1, bool)
    np.not_equal(distance[1:], distance[:-1], out=changed[1:])
    changed[0] = distance[0] != 0
    edge = changed.nonzero()[0]
    run = distance[edge].nonzero()[0]
    begin = edge[run]
    stop = np.append(edge, n)[run + 1] + (GRAM - 1)
    back = distance[begin]
    np.maximum(begin[1:], np.maximum.accumulate(stop)[:-1], out=begin[1:])
    keep = stop - begin >= 4
    begin, stop, back = begin[keep], stop[keep], back[keep]
    if (stop - begin).max(initial=0) <= LONGEST_COPY:
        return begin, stop - begin, back
    parts = -(-(stop - begin) // LONGEST_COPY)
    which = np.repeat(np.arange(len(begin)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = begin[which] + nth * LONGEST_COPY
    return start, np.minimum(stop[which] - start, LONGEST_COPY), back[which]


def _put_pixels(head: BitWriter, argb: np.ndarray, main: bool, copies: bool = False, cache_bits: int = 0) -> None:
    """Write pixels under one group of codes, with back-references or a colour cache on request."""
    flat = np.ascontiguousarray(argb, "<u4").reshape(-1)
    c = flat.view(np.uint8).reshape(-1, 4)
    head.put(int(cache_bits > 0), 1)
    if cache_bits:
        head.put(cache_bits, 4)
    if main:
        head.put(0, 1)
    constant = _green_alone(flat)
    begin, length, back = back_references(flat, constant) if copies else (np.zeros(0, np.int64),) * 3
    token = np.ones(len(flat), bool)
    if len(begin):
        # copies do not overlap, so begins are distinct, and so are ends
        covered = np.zeros(len(flat) + 1, np.int8)
        covered[begin] += 1
        covered[begin + length] -= 1
        token = covered[:-1].cumsum(dtype=np.int8) == 0
        token[begin] = True
    at = token.nonzero()[0]
    symbol = c[at, 1].astype(np.int64)
    literal = np.ones(len(at), bool)
    if len(begin):
        which = at.searchsorted(begin)
        literal[which] = False
        long_symbol, long_extra, long_more = _prefix(length)
        far_symbol, far_extra, far_more = _prefix(back + 120)
        symbol[which] = 256 + long_symbol
    else:
        far_symbol = np.zeros(0, np.int64)
    if cache_bits:
        slots, held = ((flat.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).tolist(), {}
        for k, (p, slot) in enumerate(zip(flat.tolist(), slots)):
            if held.get(slot, 0) == p:
                symbol[k], literal[k] = 280 + slot, False
            held[slot] = p
    tables = [_put_code(head, np.bincount(symbol, minlength=280 + ((1 << cache_bits) if cache_bits else 0)))]
    plain = None if constant else at[literal]
    for k in (2, 0, 3):
        if constant:
            head.put(0b101 | int(c[0, k]) << 3, 11)
        else:
            tables.append(_put_code(head, np.bincount(c[plain, k], minlength=256)))
    far = _put_code(head, np.bincount(far_symbol, minlength=40))
    # fields in order of token and place within it: at most 33 bits each
    fields = [(at * 4, tables[0][1][symbol], tables[0][0][symbol])]
    joined, size = fields[0][1], fields[0][2]
    for (lengths, codes), k in zip(tables[1:], (2, 0, 3)):
        if lengths.any():
            value = np.zeros(len(at), np.uint64)
            more = np.zeros(len(at), np.int64)
            value[literal], more[literal] = codes[c[plain, k]], lengths[c[plain, k]]
            if (size + more).max(initial=0) > 33:
                fields[-1] = (fields[-1][0], joined, size)
                fields.append((at * 4 + len(fields), value, more))
                joined, size = value, more
                continue
            joined, size = joined | value << size.astype(np.uint64), size + more
            fields[-1] = (fields[-1][0], joined, size)
    if len(begin):
        joined, size = fields[0][1].copy(), fields[0][2].copy()
        joined[which] |= long_extra.astype(np.uint64) << size[which].astype(np.uint64)
        size[which] += long_more
        fields[0] = (fields[0][0], joined, size)
        fields.append((begin * 4 + 3, far[1][far_symbol] | far_extra.astype(np.uint64) << far[0][far_symbol].astype(np.uint64), far[0][far_symbol] + far_more))
    if len(fields) > 1:
        order = np.argsort(np.concatenate([f[0] for f in fields]), kind="stable")
        joined, size = (np.concatenate([f[k] for f in fields])[order] for k in (1, 2))
    base = head.size
    upto = np.cumsum(size)
    total = int(upto[-1])
    at = (base & 31) + upto - size
    window = joined << (at & 31).astype(np.uint64)
    word = at >> 5
    out = np.zeros((((base & 31) + total) >> 5) + 2)
    for values, shift in ((window & np.uint64(0xFFFFFFFF), 0), (window >> np.uint64(32), 1)):
        sums = np.bincount(word, weights=values)
        out[shift : shift + len(sums)] += sums
    head.value |= int.from_bytes(out.astype("<u4").tobytes(), "little") << (base - (base & 31))
    head.size = base + total


def _guesses(c: np.ndarray) -> np.ndarray:
    """What each of the 14 predictors says of each pixel, (14, height, width, 4), from the true neighbours."""
    height, width, _ = c.shape
    p = c.astype(np.int32)
    black = np.broadcast_to(np.array([0, 0, 0, 255]), p.shape)
    left, top = np.roll(p, 1, axis=1), np.roll(p, 1, axis=0)
    corner = np.roll(top, 1, axis=1)
    right = np.roll(top, -1, axis=1)
    right[:, -1] = p[:, 0]  # the first pixel of the row itself stands for the one beyond the row above
    half = lambda a, b: (a + b) >> 1
    near_left = np.abs(top - corner).sum(axis=2, keepdims=True) < np.abs(left - corner).sum(axis=2, keepdims=True)
    mean = half(left, top)
    step = mean - corner
    out = np.stack([
        black, left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top), half(corner, top), half(top, right), half(half(left, corner), half(top, right)),
        np.where(near_left, left, top), np.clip(left + top - corner, 0, 255), np.clip(mean + np.sign(step) * (np.abs(step) >> 1), 0, 255),
    ])
    out[:, 0], out[:, :, 0] = left[0], top[:, 0]
    out[:, 0, 0] = black[0, 0]
    return out


def _blocks(values: np.ndarray, size_bits: int) -> np.ndarray:
    """Sums over square blocks of the last two axes."""
    step = 1 << size_bits
    return np.add.reduceat(np.add.reduceat(values, np.arange(0, values.shape[-2], step), axis=-2), np.arange(0, values.shape[-1], step), axis=-1)


def _predicted(argb: np.ndarray, size_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals under the predictor that leaves least in each block, and the image of predictors."""
    c = _channels(argb)
    rest = (c - _guesses(c)) & 255
    modes = _blocks(np.minimum(rest, 256 - rest).sum(axis=-1), size_bits).argmin(axis=0)
    height, width = argb.shape
    by = modes[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits]
    chosen = np.take_along_axis(rest, by[None, :, :, None], axis=0)[0].astype(np.uint8)
    return np.ascontiguousarray(chosen).view("<u4").reshape(height, width), (modes << 8).astype(np.uint32)


def _uncrossed(argb: np.ndarray, size_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Red and blue less what green (and red) tell of them by least squares in each block, and the image of factors."""
    c = _channels(argb)
    signed = c.view(np.int8).astype(np.int64)
    blue, green, red = (signed[..., k] for k in range(3))
    factor = lambda a, b: np.clip(np.rint(32 * _blocks(a * b, size_bits) / np.maximum(1, _blocks(b * b, size_bits))), -128, 127).astype(np.int64)
    at = (np.arange(argb.shape[0])[:, None] >> size_bits, np.arange(argb.shape[1])[None, :] >> size_bits)
    to_red, to_blue = factor(red, green), factor(blue, green)
    rest = blue - ((to_blue[at] * green) >> 5)
    from_red = factor(rest, red)
    out = np.stack([rest - ((from_red[at] * red) >> 5), green, red - ((to_red[at] * green) >> 5), c[..., 3]], axis=-1).astype(np.uint8)
    factors = np.stack([to_red, to_blue, from_red, np.full_like(to_red, 255)], axis=-1).astype(np.uint8)
    return out.view("<u4").reshape(argb.shape), factors.view("<u4").reshape(to_red.shape)


def _bits(values: list[np.ndarray]) -> list[float]:
    """Bits that samples of 0 to 255 take at their entropy, for each of some arrays."""
    counts = np.stack([np.bincount(v.reshape(-1), minlength=256) for v in values])
    total = counts.sum(axis=1, keepdims=True)
    return (counts * np.log2(np.maximum(total, 1) / np.maximum(counts, 1))).sum(axis=1).tolist()


def _steps_are_less(argb: np.ndarray, n_colours: int) -> bool:
    """Whether steps from the left or upper neighbour take fewer bits than the samples under a palette do."""
    planes = [(argb >> np.uint32(8)).astype(np.uint8)] if _green_alone(argb) else np.moveaxis(_channels(argb), 2, 0)
    direct = left = above = 0.0
    for plane in planes:
        plain, across, down = _bits([plane, plane[:, 1:] - plane[:, :-1], plane[1:] - plane[:-1]])
        direct += plain
        left += across if plane.shape[1] > 1 else np.inf
        above += down if len(plane) > 1 else np.inf
    # a palette takes about a byte a colour; blocks of predictors and factors, and more codes, take their share too
    return min(left, above) + 256 + argb.size / 16 < direct + 8 * n_colours


def encode_webp(argb: np.ndarray, cache_bits: int = 0, size_bits: int = 4) -> bytes:
    """A lossless WebP file: by palette up to 256 colours, else predicted, uncrossed and less green.

    A picture of few colours whose steps look cheaper than its samples is written both ways; the shorter file stays.
    """
    argb = np.ascontiguousarray(argb, "<u4")
    colours, index = _colours(argb)
    ways = [(colours, index)]
    if colours is not None and _steps_are_less(argb, len(colours)):
        ways.append((None, argb))
    return min((_encoded(argb, *way, cache_bits, size_bits) for way in ways), key=len)


def _encoded(argb: np.ndarray, colours: np.ndarray | None, index: np.ndarray, cache_bits: int, size_bits: int) -> bytes:
    height, width = argb.shape
    head = BitWriter()
    # the hint that alpha is in use
    alpha = (argb ^ argb.reshape(-1)[0]) >> np.uint32(24)
    head.put(width - 1 | (height - 1) << 14 | int(alpha.any()) << 28, 32)
    if colours is not None:
        head.put(1 | 3 << 1, 3)
        head.put(len(colours) - 1, 8)
        steps = _channels(colours).copy()
        steps[1:] -= _channels(colours)[:-1]
        _put_pixels(head, steps.view("<u4").reshape(1, -1), False)
        width_bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        if width_bits:
            each, ways = 8 >> width_bits, 1 << width_bits
            wide = np.zeros((height, -(-width // ways) * ways), np.uint32)
            wide[:, :width] = index
            index = (wide.reshape(height, -1, ways) << (np.arange(ways, dtype=np.uint32) * each)).sum(axis=2)
        argb = index.astype("<u4") << np.uint32(8)
    else:
        for kind, step in ((0, _predicted), (1, _uncrossed)):
            argb, image = step(argb, size_bits)
            head.put(1 | kind << 1 | (size_bits - 2) << 3, 6)
            _put_pixels(head, image, False)
        head.put(1 | 2 << 1, 3)
        c = _channels(argb).copy()
        c[..., 0] -= c[..., 1]
        c[..., 2] -= c[..., 1]
        argb = c.view("<u4").reshape(argb.shape)
    head.put(0, 1)
    _put_pixels(head, argb, True, copies=not cache_bits, cache_bits=cache_bits)
    chunk = b"\x2f" + head.value.to_bytes((head.size + 7) >> 3, "little")
    pad = bytes(len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + pad


def _colours(argb: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Up to 256 colours in order, and each pixel's number."""
    flat = argb.reshape(-1)
    if not _green_alone(flat):
        colours = np.unique(flat)
        if len(colours) > 256:
            return None, argb
        return colours.astype("<u4"), np.searchsorted(colours, argb).astype(np.uint32)
    # all in the green channel
    green = (argb >> np.uint32(8)).astype(np.uint8)
    seen = np.bincount(green.reshape(-1), minlength=256) > 0
    number = (np.cumsum(seen) - 1).astype(np.uint32)
    return (np.flatnonzero(seen).astype("<u4") << 8) | (flat[0] & np.uint32(0xFFFF00FF)), number.take(green)


def to_media(payload: bytes) -> bytes:
    """WebP files of 64 pixels by up to 16384 (1 MiB each), one after another; one byte a pixel, in green, alpha unused."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(encode_webp(samples[k : k + MAX_SIDE].astype(np.uint32) << np.uint32(8)) for k in range(0, len(samples), MAX_SIDE))


def from_media(media: bytes) -> bytes:
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append((decode_webp(media[at:end]) >> 8).astype(np.uint8).tobytes())
        at = end
    return b"".join(out)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text as lossless WebP (zero bytes up to a positive multiple of 64).

    A null text is empty. Every row gives a row, also for null or repeated ids. Other columns
    are ignored.
    """

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [to_media(t + bytes(-len(t) % 64 if t else 64)) for t in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def feature(samples: np.ndarray) -> str:
    """Sum, number of distinct samples, and summed steps between neighbours."""
    return f"sum={int(samples.sum(dtype=np.int64))};distinct={len(np.flatnonzero(np.bincount(samples)))};steps={int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64))}"


def media_features(media: DataFrame) -> DataFrame:
    """Decode the stored bytes and describe what they hold."""

    @tidy
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in batch.column(2):
                stored = blob.as_py()
                payload = from_media(stored)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(np.frombuffer(payload, np.uint8))))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(decode, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
