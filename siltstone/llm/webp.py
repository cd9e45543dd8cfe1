"""Lossless WebP (VP8L) in a RIFF container: a full decoder, and an encoder of any transforms.

The decoder reads prefix codes, meta prefix codes, back-references and the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette transforms. Symbols are looked up
by their next bits, a window of 64 bits a pixel. Predictor modes that need the row above only are
inverted row by row as arrays, others pixel by pixel.

``encode`` writes small images with the transforms asked for, back-references, a colour cache and
Huffman codes; ``webp_batch`` writes many images at once and picks transforms by itself. Pixels
are arrays of unsigned 32-bit ARGB.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SIGNATURE = 0x2F
MAX_SIDE = 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_CODES, DISTANCE_CODES = 24, 40

# fixed values of the format
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
#: Places of the 120 nearest pixels, as (columns left, rows up), by distance code.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        """The next ``n`` bits; zeros after the end."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        self.check()
        return value

    def check(self) -> None:
        if self.at > self.size:
            raise ValueError("the image ends too early")


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bits(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), dtype=np.uint8)
        return np.unpackbits(raw, bitorder="little", count=self.n)


MAX_LENGTH = 15


@lru_cache
def reversal(n: int) -> np.ndarray:
    """Numbers of ``n`` bits with their bits in reverse."""
    k = np.arange(1 << n, dtype=np.int64)
    return sum(((k >> i) & 1) << (n - 1 - i) for i in range(n)) if n else k


def canonical(lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols in order of their codes, code lengths, codes with the first bit lowest); a lone symbol's length is 0."""
    lengths = np.asarray(lengths, dtype=np.int64)
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return used, np.zeros(1, np.int64), np.zeros(1, np.int64)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order]
    room = np.left_shift(1, MAX_LENGTH - n)
    first = np.cumsum(room) - room  # each code, filled up with zeros to MAX_LENGTH bits
    return order, n, reversal(MAX_LENGTH)[first]


class PrefixCode:
    """Decodes symbols of one alphabet by their next ``width`` bits: ``by_bits`` and ``sizes`` by these bits."""

    def __init__(self, lengths):
        order, n, _ = canonical(lengths)
        if not len(order):
            raise ValueError("a prefix code has no symbols")
        self.width = int(n[-1])
        self.mask = (1 << self.width) - 1
        if self.width == 0:
            self.by_bits, self.sizes = order, [0]
        else:
            times, turn = np.left_shift(1, self.width - n), reversal(self.width)
            if int(times.sum()) != 1 << self.width:
                raise ValueError("a prefix code is not complete")
            self.by_bits = order.repeat(times)[turn]
            self.sizes = n.repeat(times)[turn].tolist()
        self.symbols = self.by_bits.tolist()

    def read(self, bits: BitReader) -> int:
        k = bits.peek(self.width)
        bits.at += self.sizes[k]
        return self.symbols[k]


@lru_cache(maxsize=4096)
def short_code(lengths: tuple[int, ...]) -> PrefixCode:
    """The code of a few lengths; images share many of these."""
    return PrefixCode(lengths)


@lru_cache(maxsize=4096)
def simple_code(*symbols: int) -> PrefixCode:
    """The code of one or two symbols that are written out."""
    return short_code(tuple(int(s in symbols) for s in range(max(symbols) + 1)))


#: Codes that were read, by alphabet and first 64 bits: (bits, their mask, how many, the code).
_known: dict[tuple[int, int], list[tuple[int, int, int, PrefixCode]]] = {}
KNOWN_CODES = 1024
LENGTHS_BYTES = 1024  # more than the lengths of any alphabet take


def read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    """A prefix code; one that was read before is known by its bits."""
    start = bits.at
    if not bits.peek(1):
        first = start >> 3
        ahead = int.from_bytes(bits.data[first : first + LENGTHS_BYTES], "little") >> (start & 7)
        key = (alphabet, ahead & 0xFFFFFFFFFFFFFFFF)
        for value, mask, n, code in _known.get(key, ()):
            if ahead & mask == value and start + n <= bits.size:
                bits.at += n
                return code
    code = _read_new_code(bits, alphabet)
    n = bits.at - start
    if n > 64 and alphabet > DISTANCE_CODES:
        if len(_known) >= KNOWN_CODES:
            _known.clear()
        mask = (1 << n) - 1
        _known.setdefault(key, []).append((ahead & mask, mask, n, code))
    return code


def _read_new_code(bits: BitReader, alphabet: int) -> PrefixCode:
    first = bits.at >> 3
    ahead = int.from_bytes(bits.data[first : first + 9], "little") >> (bits.at & 7)
    if ahead & 1:  # one or two symbols, written out
        two, wide = ahead & 2, 8 if ahead & 4 else 1
        symbols = (ahead >> 3 & (1 << wide) - 1, *((ahead >> 3 + wide & 255,) if two else ()))
        bits.at += 3 + wide + (8 if two else 0)
        bits.check()
        return simple_code(*symbols)
    of_lengths = [0] * 19
    upto = 4 + (ahead >> 1 & 15)
    for k, i in enumerate(CODE_LENGTH_ORDER[:upto]):
        of_lengths[i] = ahead >> 5 + 3 * k & 7
    bits.at += 5 + 3 * upto
    bits.check()
    code = short_code(tuple(of_lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths: list[int] = []
    before, first = 8, bits.at >> 3
    ahead = int.from_bytes(bits.data[first : first + LENGTHS_BYTES + (left >> 3)], "little") >> (bits.at & 7)
    symbols, sizes, mask = code.symbols, code.sizes, code.mask
    while len(lengths) < alphabet and left:
        left -= 1
        k = ahead & mask
        s, n = symbols[k], sizes[k]
        ahead >>= n
        if s < 16:
            lengths.append(s)
            before = s or before
        else:
            value, times, more = ((before, 3, 2), (0, 3, 3), (0, 11, 7))[s - 16]
            lengths += [value] * (times + (ahead & ((1 << more) - 1)))
            ahead >>= more
            n += more
        bits.at += n
    bits.check()
    if len(lengths) > alphabet:
        raise ValueError("code lengths run over the alphabet")
    return PrefixCode(lengths) if len(lengths) > 40 else short_code(tuple(lengths))


def prefix_value(bits: BitReader, code: int) -> int:
    """A length or distance code from its prefix symbol."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def near_distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


@lru_cache(maxsize=64)
def near_codes(width: int) -> dict[int, int]:
    """The smallest code of each near distance."""
    return {near_distance(c, width): c for c in range(len(NEAR), 0, -1)}


def blocks(side: int, bits: int) -> int:
    return (side + (1 << bits) - 1) >> bits


class Coded:
    """An entropy-coded image up to its first pixel: its codes by group, and which block has which group."""

    def __init__(self, bits: BitReader, width: int, height: int, main: bool):
        self.bits, self.width, self.height = bits, width, height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("the colour cache is too large")
        groups, self.meta = 1, None
        if main and bits.read(1):  # only the main image may have several groups of codes
            self.meta_bits = bits.read(3) + 2
            across = blocks(width, self.meta_bits)
            self.meta = (read_image(bits, across, blocks(height, self.meta_bits), False) >> 8) & 0xFFFF
            groups = int(self.meta.max()) + 1
        green = 256 + LENGTH_CODES + (1 << self.cache_bits if self.cache_bits else 0)
        self.codes = [[read_code(bits, n) for n in (green, 256, 256, 256, DISTANCE_CODES)] for _ in range(groups)]

    def pixels(self) -> np.ndarray:
        n = self.width * self.height
        if self.meta is None:
            lone = [c.symbols[0] for c in self.codes[0][:4] if c.width == 0]
            if len(lone) == 4 and lone[0] < 256:  # one colour takes no bits
                return np.full(n, lone[3] << 24 | lone[1] << 16 | lone[0] << 8 | lone[2], dtype=np.uint32)
            cache = [0] * (1 << self.cache_bits)
            return np.array(read_pixels(self.bits, self.codes[0], self.width, n, self.cache_bits, cache, []), dtype=np.uint32)
        return self._by_block(n)

    def _by_block(self, n: int) -> np.ndarray:
        bits, width, cache_bits, across = self.bits, self.width, self.cache_bits, blocks(self.width, self.meta_bits)
        cache = [0] * (1 << cache_bits) if cache_bits else None
        pixels, at = [0] * n, 0
        while at < n:
            code = self.codes[int(self.meta[(at // width >> self.meta_bits) * across + (at % width >> self.meta_bits)])]
            s = code[0].read(bits)
            start = at
            if s < 256:
                red, blue, alpha = (code[i].read(bits) for i in (1, 2, 3))
                pixels[at] = alpha << 24 | red << 16 | s << 8 | blue
                at += 1
            elif s < 256 + LENGTH_CODES:
                length = prefix_value(bits, s - 256)
                distance = near_distance(prefix_value(bits, code[4].read(bits)), width)
                if distance > at or at + length > n:
                    raise ValueError("a back-reference leaves the image")
                for _ in range(length):
                    pixels[at] = pixels[at - distance]
                    at += 1
            else:
                if cache is None:
                    raise ValueError("no colour cache")
                pixels[at] = cache[s - 256 - LENGTH_CODES]
                at += 1
            bits.check()
            if cache is not None:
                for p in pixels[start:at]:
                    cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        return np.array(pixels, dtype=np.uint32)


def read_image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    return Coded(bits, width, height, main).pixels()


WINDOW_BYTES = 1 << 16


def read_pixels(
    bits: BitReader, codes: list[PrefixCode], width: int, n: int, cache_bits: int, cache: list[int], out: list[int]
) -> list[int]:
    """``out`` and the pixels after it up to ``n``, of one group of codes; a window of 64 bits holds one pixel's symbols."""
    green, red, blue, alpha, far = codes
    green_symbols, green_sizes, green_mask = green.symbols, green.sizes, green.mask
    red_values, red_sizes, red_mask = (red.by_bits << 16).tolist(), red.sizes, red.mask
    blue_values, blue_sizes, blue_mask = blue.symbols, blue.sizes, blue.mask
    alpha_values, alpha_sizes, alpha_mask = (alpha.by_bits << 24).tolist(), alpha.sizes, alpha.mask
    opaque = alpha_values[0] if alpha.width == 0 else None
    turn, add = 32 - cache_bits, out.append
    raw = np.frombuffer(bits.data, dtype=np.uint8)
    at, size, left = bits.at, bits.size, n - len(out)
    base, upto, windows = 0, -1, []
    while left > 0:
        k = at >> 3
        if k >= upto:
            if at > size:
                raise ValueError("the image ends too early")
            base, upto = k, k + WINDOW_BYTES
            some = np.zeros(min(WINDOW_BYTES, len(raw) - k + 1) + 8, dtype=np.uint8)
            part = raw[k : k + len(some)]
            some[: len(part)] = part
            windows = np.lib.stride_tricks.sliding_window_view(some, 8).copy().view("<u8")[:, 0].tolist()
            upto = base + len(windows)
        window = windows[k - base] >> (at & 7)
        k = window & green_mask
        s, took = green_symbols[k], green_sizes[k]
        if s < 256:
            window >>= took
            i = window & red_mask
            took += (more := red_sizes[i])
            window >>= more
            j = window & blue_mask
            if opaque is None:
                window >>= blue_sizes[j]
                k = window & alpha_mask
                p = alpha_values[k] | red_values[i] | s << 8 | blue_values[j]
                at += took + blue_sizes[j] + alpha_sizes[k]
            else:
                p = opaque | red_values[i] | s << 8 | blue_values[j]
                at += took + blue_sizes[j]
            add(p)
            left -= 1
            if cache_bits:
                cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> turn] = p
        elif s >= 256 + LENGTH_CODES:
            if not cache_bits:
                raise ValueError("no colour cache")
            add(cache[s - 256 - LENGTH_CODES])
            left -= 1
            at += took
        else:
            bits.at = at + took
            length = prefix_value(bits, s - 256)
            distance = near_distance(prefix_value(bits, far.read(bits)), width)
            at = bits.at
            if distance > len(out) or length > left:
                raise ValueError("a back-reference leaves the image")
            start = len(out) - distance
            if distance >= length:
                copied = out[start : start + length]
            else:
                copied = (out[start:] * (length // distance + 1))[:length]
            out += copied
            left -= length
            if cache_bits:
                for p in copied:
                    cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> turn] = p
    bits.at = at
    bits.check()
    return out


def channels(argb) -> np.ndarray:
    """Alpha, red, green, blue as signed rows."""
    a = np.asarray(argb, dtype=np.uint32)
    return np.stack([(a >> s) & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def joined(c: np.ndarray) -> np.ndarray:
    c = (c & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left, top, top_left, top_right):
    """The predicted pixel, from neighbours as lists of four channels."""
    half = lambda p, q: [(x + y) >> 1 for x, y in zip(p, q, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        far_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        far_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if far_left < far_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        middle = half(left, top)
        return [clamp(m + int((m - c) / 2)) for m, c in zip(middle, top_left, strict=True)]
    return [255, 0, 0, 0]


def _neighbours(done: list, at: int, width: int, mode: int):
    x, y = at % width, at // width
    if at == 0:
        return [255, 0, 0, 0]
    if y == 0:
        return done[at - 1]
    if x == 0:
        return done[at - width]
    # right of the last column stands the first pixel of the row itself
    return predict(mode, done[at - 1], done[at - width], done[at - width - 1], done[at - width + 1])


#: Modes that need the row above only: black, top, top right, top left, and means of two of these.
ROW_MODES = (0, 2, 3, 4, 8, 9)


def from_above(mode: int, top_left, top, top_right):
    """What one of ``ROW_MODES`` predicts, from arrays of unsigned bytes."""
    mean = lambda p, q: (p & q) + ((p ^ q) >> 1)
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    return mean(top_left, top) if mode == 8 else mean(top, top_right)


def _invert_rows(argb: np.ndarray, width: int, kinds: np.ndarray, bits: int) -> np.ndarray:
    """Inverts ``ROW_MODES``, a row at a time; bytes wrap around as the format asks."""
    done = argb.astype("<u4").view(np.uint8).reshape(-1, width, 4).copy()  # blue, green, red, alpha
    done[0, 0, 3] = (int(done[0, 0, 3]) + 255) & 255
    np.cumsum(done[0], axis=0, dtype=np.uint8, out=done[0])
    near = np.empty((width + 2, 4), dtype=np.uint8)  # the row above, one place later
    for y in range(1, len(done)):
        here, above = done[y], done[y - 1]
        here[0] += above[0]
        near[1:-1] = above
        near[-1] = here[0]  # right of the last column stands the first pixel of the row itself
        if y & ((1 << bits) - 1) == 0 or y == 1:  # blocks that lie side by side and have one mode, as one
            row = kinds[y >> bits].tolist()
            cuts = [k for k in range(len(row)) if not k or row[k] != row[k - 1]]
            spans = [(row[k], max(1, k << bits), min(width, j << bits)) for k, j in zip(cuts, [*cuts[1:], len(row)], strict=True)]
        for mode, a, b in spans:
            if mode == 0:
                here[a:b, 3] += 255
            elif a < b:
                here[a:b] += from_above(mode, near[a:b], near[a + 1 : b + 1], near[a + 2 : b + 2])
    return done.reshape(-1).view("<u4").astype(np.uint32)


def invert_predictor(argb: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    numbers = (modes >> 8) & 15
    if set(numbers.tolist()).issubset(ROW_MODES):
        return _invert_rows(argb, width, numbers.reshape(-1, blocks(width, bits)), bits)
    rest, across = channels(argb).tolist(), blocks(width, bits)
    kinds = ((modes >> 8) & 15).tolist()
    done: list = []
    for at, r in enumerate(rest):
        mode = kinds[(at // width >> bits) * across + (at % width >> bits)]
        p = _neighbours(done, at, width, mode)
        done.append([(a + b) & 255 for a, b in zip(r, p, strict=True)])
    return joined(np.array(done, dtype=np.int64))


def apply_predictor(argb: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    whole, across = channels(argb).tolist(), blocks(width, bits)
    kinds = ((modes >> 8) & 15).tolist()
    out = []
    for at, p in enumerate(whole):
        mode = kinds[(at // width >> bits) * across + (at % width >> bits)]
        out.append([a - b for a, b in zip(p, _neighbours(whole, at, width, mode), strict=True)])
    return joined(np.array(out, dtype=np.int64))


def cross_colour(argb: np.ndarray, width: int, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Add (sign 1) or take away (-1) what the block's element makes of green and red."""
    if not (elements & 0xFFFFFF).any():
        return argb
    c = channels(argb)
    at = np.arange(len(argb))
    e = channels(elements)[(at // width >> bits) * blocks(width, bits) + (at % width >> bits)]
    signed = lambda v: (v & 0xFF ^ 0x80) - 0x80
    delta = lambda t, v: signed(t) * signed(v) >> 5
    red, green = c[:, 1].copy(), c[:, 2]
    new_red = (red + sign * delta(e[:, 3], green)) & 0xFF
    true_red = new_red if sign > 0 else red
    blue = c[:, 3] + sign * (delta(e[:, 2], green) + delta(e[:, 1], true_red))
    c[:, 1], c[:, 3] = new_red, blue
    return joined(c)


def shift_green(argb: np.ndarray, sign: int) -> np.ndarray:
    c = channels(argb)
    c[:, 1] += sign * c[:, 2]
    c[:, 3] += sign * c[:, 2]
    return joined(c)


def palette_bits(size: int) -> int:
    """Pixels in a bundle, as a power of two."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def unbundle(argb: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    power = palette_bits(len(palette))
    green = ((argb >> 8) & 0xFF).reshape(height, blocks(width, power))
    each = 8 >> power
    if power:
        index = np.stack([green >> (each * k) & ((1 << each) - 1) for k in range(1 << power)], axis=-1)
        green = index.reshape(height, -1)[:, :width]
    full = np.zeros(256, dtype=np.uint32)  # what lies outside the palette is transparent black
    full[: len(palette)] = palette
    return full[green.reshape(-1)]


class Opened:
    """A lossless WebP file read up to the first pixel of its main image."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
            raise ValueError("no WebP file")
        at = 12
        while at + 8 <= len(data) and data[at : at + 4] != b"VP8L":
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            at += 8 + size + (size & 1)
        if data[at : at + 4] != b"VP8L":
            raise ValueError("no lossless image in the file")
        bits = BitReader(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
        if bits.read(8) != SIGNATURE:
            raise ValueError("no lossless image")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)  # whether alpha is used is only a hint
        if bits.read(3):
            raise ValueError("unknown version")
        self.transforms: list[tuple[int, int, np.ndarray | None, int]] = []  # kind, width, its own image, block size
        wide = self.width
        while bits.read(1):
            kind, table, size = bits.read(2), None, 0
            if kind in (t[0] for t in self.transforms):
                raise ValueError("a transform comes twice")
            if kind in (PREDICTOR, CROSS_COLOUR):
                size = bits.read(3) + 2
                table = read_image(bits, blocks(wide, size), blocks(self.height, size), False)
            elif kind == PALETTE:
                steps = channels(read_image(bits, bits.read(8) + 1, 1, False))
                table = joined(np.cumsum(steps, axis=0))
            self.transforms.append((kind, wide, table, size))
            if kind == PALETTE:
                wide = blocks(wide, palette_bits(len(table)))
        self.coded = Coded(bits, wide, self.height, True)

    def inverted(self, pixels: np.ndarray) -> np.ndarray:
        """The image's pixels from those of its main entropy-coded image."""
        for kind, wide, table, size in reversed(self.transforms):
            if kind == PREDICTOR:
                pixels = invert_predictor(pixels, wide, table, size)
            elif kind == CROSS_COLOUR:
                pixels = cross_colour(pixels, wide, table, size, 1)
            elif kind == SUBTRACT_GREEN:
                pixels = shift_green(pixels, 1)
            else:
                pixels = unbundle(pixels, wide, self.height, table)
        return pixels


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels row by row) of a lossless WebP file."""
    opened = Opened(data)
    return opened.width, opened.height, opened.inverted(opened.coded.pixels())


def riff(bits: np.ndarray) -> bytes:
    body = np.packbits(bits, bitorder="little").tobytes()
    pad = b"\0" * (len(body) & 1)
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + pad
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def write_head(out: BitWriter, width: int, height: int) -> None:
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE):
        raise ValueError(f"{width} x {height} pixels: sides go from 1 to {MAX_SIDE}")
    out.write(SIGNATURE, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(0, 4)  # no alpha, version 0


def write_lengths(out: BitWriter, lengths) -> None:
    """A prefix code by its lengths: one or two symbols as they are, else with runs of equal lengths."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and used[-1] < 256:
        write_simple(out, *used)
        return
    written = np.array(lengths[: max(2, used[-1] + 1)])
    steps: list[tuple[int, int, int]] = []  # symbol, extra bits' value, how many
    ends = [*np.flatnonzero(np.diff(written)).tolist(), len(written) - 1]
    at = 0
    for end in ends:
        n, times = int(written[at]), end + 1 - at
        at = end + 1
        if n:
            steps.append((n, 0, 0))
            times -= 1
            while times >= 3:
                some = min(times, 6)
                steps.append((16, some - 3, 2))
                times -= some
        else:
            while times >= 11:
                some = min(times, 138)
                steps.append((18, some - 11, 7))
                times -= some
            if times >= 3:
                steps.append((17, times - 3, 3))
                times = 0
        steps += [(n, 0, 0)] * times
    counts = [0] * 19
    for symbol, _, _ in steps:
        counts[symbol] += 1
    of_lengths = huffman_lengths(counts, 7)
    upto = max(4, 1 + max(i for i, k in enumerate(CODE_LENGTH_ORDER) if of_lengths[k]))
    out.write((upto - 4) << 1, 5)
    for i in CODE_LENGTH_ORDER[:upto]:
        out.write(of_lengths[i], 3)
    if len(steps) == len(lengths):
        out.write(0, 1)
    else:
        out.write(1, 1)
        size = max(2, (len(steps) - 2).bit_length())
        size += size & 1
        out.write((size - 2) // 2, 3)
        out.write(len(steps) - 2, size)
    codes = codes_of(tuple(of_lengths))
    bits = n_bits = 0
    for symbol, extra, n in steps:
        code, size = codes[symbol]
        bits |= (code | extra << size) << n_bits
        n_bits += size + n
    out.write(bits, n_bits)


def write_simple(out: BitWriter, first: int, second: int | None = None) -> None:
    """A prefix code of one or two symbols under 256, in order."""
    out.write(1 | (second is not None) << 1 | 1 << 2 | first << 3, 11)
    if second is not None:
        out.write(second, 8)


@lru_cache(maxsize=4096)
def codes_of(lengths: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Symbol to (code with the first bit lowest, its length)."""
    order, n, codes = canonical(lengths)
    return dict(zip(order.tolist(), zip(codes.tolist(), n.tolist(), strict=True), strict=True))


def write_plain(out: BitWriter, argb: np.ndarray) -> None:
    """A small entropy-coded image, such as a transform's own: no cache, no references."""
    out.write(0, 1)
    columns = [[p >> shift & 255 for p in argb.tolist()] for shift in (8, 16, 0, 24)]
    coded: list[list[tuple[int, int]]] = []
    for column in columns:
        kinds = sorted(set(column))
        if len(kinds) <= 2:
            write_simple(out, *kinds)
            if len(kinds) == 2:
                coded.append([(int(v == kinds[1]), 1) for v in column])
            continue
        counts = [0] * 256
        for v in column:
            counts[v] += 1
        lengths = huffman_lengths(counts)
        write_lengths(out, lengths)
        codes = codes_of(tuple(lengths))
        coded.append([codes[v] for v in column])
    write_simple(out, 0)  # a distance code that nothing uses
    bits = n_bits = 0
    for pixel in zip(*coded, strict=True):
        for code, n in pixel:
            bits |= code << n_bits
            n_bits += n
    out.write(bits, n_bits)


def write_symbol(out: BitWriter, codes: dict[int, tuple[int, int]], s: int) -> None:
    out.write(*codes[s])


def huffman_lengths(counts: list[int], limit: int = MAX_LENGTH) -> list[int]:
    """Lengths of a Huffman code, no longer than ``limit``: rare symbols are counted up until it fits."""
    lengths = [0] * len(counts)
    used = sorted((c, s) for s, c in enumerate(counts) if c)
    if len(used) < 2:
        lengths[used[0][1] if used else 0] = 1
        return lengths
    m, least = len(used), 1
    while True:
        # leaves by count, then inner nodes in the order they are made, which is also by count
        weight = [max(c, least) for c, _ in used]
        parent = [0] * (2 * m - 1)
        leaf, inner = 0, m
        for node in range(m, 2 * m - 1):
            total = 0
            for _ in range(2):
                if leaf < m and (inner >= node or weight[leaf] <= weight[inner]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, inner = inner, inner + 1
                parent[k] = node
                total += weight[k]
            weight.append(total)
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:m]) <= limit:
            break
        least *= 2
    for (_, s), n in zip(used, depth, strict=False):
        lengths[s] = n
    return lengths


def prefix_symbol(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits' value, how many) of a length or distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), v & ((1 << extra) - 1), extra


def write_image(out: BitWriter, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    """An entropy-coded image with Huffman codes, and if asked for, back-references and a cache."""
    pixels = [int(p) for p in argb]
    steps: list[tuple] = []
    cache = [None] * (1 << cache_bits) if cache_bits else None
    last: dict[tuple[int, int, int], int] = {}
    near = near_codes(width) if references else {}
    at = 0
    while at < len(pixels):
        start, key = at, tuple(pixels[at : at + 3])
        before = last.get(key) if references and len(key) == 3 else None
        slot = (pixels[at] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if before is not None:
            n = 3
            while at + n < len(pixels) and n < 4096 and pixels[before + n] == pixels[at + n]:
                n += 1
            d = at - before
            steps.append(("copy", prefix_symbol(n), prefix_symbol(near.get(d, d + len(NEAR)))))
            at += n
        elif cache is not None and cache[slot] == pixels[at]:
            steps.append(("cached", 256 + LENGTH_CODES + slot))
            at += 1
        else:
            steps.append(("pixel", pixels[at]))
            at += 1
        for i in range(start, at):
            last[tuple(pixels[i : i + 3])] = i
            if cache is not None:
                cache[(pixels[i] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[i]
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    counts = [[0] * n for n in sizes]
    for kind, *what in steps:
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                counts[k][what[0] >> shift & 0xFF] += 1
        elif kind == "cached":
            counts[0][what[0]] += 1
        else:
            counts[0][256 + what[0][0]] += 1
            counts[4][what[1][0]] += 1
    out.write(1 if cache_bits else 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    if main:
        out.write(0, 1)
    codes = []
    for c in counts:
        lengths = huffman_lengths(c)
        write_lengths(out, lengths)
        codes.append(codes_of(tuple(lengths)))
    for kind, *what in steps:
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                write_symbol(out, codes[k], what[0] >> shift & 0xFF)
        elif kind == "cached":
            write_symbol(out, codes[0], what[0])
        else:
            (s, extra, n), (t, far, m) = what
            write_symbol(out, codes[0], 256 + s)
            out.write(extra, n)
            write_symbol(out, codes[4], t)
            out.write(far, m)


def encode(
    argb: np.ndarray,
    width: int,
    height: int,
    transforms: tuple[int, ...] = (),
    block_bits: int = 2,
    modes: tuple[int, ...] = tuple(range(14)),
    cache_bits: int = 0,
    references: bool = True,
) -> bytes:
    """A file of the pixels with ``transforms`` in this order; modes and elements change from block to block."""
    out = BitWriter()
    write_head(out, width, height)
    pixels, wide = np.asarray(argb, dtype=np.uint32), width
    for kind in transforms:
        out.write(1, 1)
        out.write(kind, 2)
        count = blocks(wide, block_bits) * blocks(height, block_bits)
        if kind == PREDICTOR:
            table = np.array([0xFF000000 | modes[k % len(modes)] << 8 for k in range(count)], dtype=np.uint32)
            pixels = apply_predictor(pixels, wide, table, block_bits)
        elif kind == CROSS_COLOUR:
            table = np.array([0xFF000000 | (k * 37 & 0xFFFFFF) for k in range(count)], dtype=np.uint32)
            pixels = cross_colour(pixels, wide, table, block_bits, -1)
        elif kind == SUBTRACT_GREEN:
            pixels = shift_green(pixels, -1)
        else:
            palette, index = np.unique(pixels, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("a palette has up to 256 colours")
            out.write(len(palette) - 1, 8)
            steps = joined(np.diff(channels(palette), axis=0, prepend=0))
            write_image(out, steps, len(palette), False)
            power = palette_bits(len(palette))
            each, narrow = 8 >> power, blocks(wide, power)
            rows = np.zeros((height, narrow << power), dtype=np.uint32)
            rows[:, :wide] = index.reshape(height, wide)
            packed = np.zeros((height, narrow), dtype=np.uint32)
            for k in range(1 << power):
                packed |= rows[:, k :: 1 << power] << np.uint32(each * k)
            pixels, wide = np.uint32(0xFF000000) | packed.reshape(-1) << np.uint32(8), narrow
        if kind in (PREDICTOR, CROSS_COLOUR):
            out.write(block_bits - 2, 3)
            write_image(out, table, blocks(wide, block_bits), False)
    out.write(0, 1)
    write_image(out, pixels, wide, True, cache_bits, references)
    return riff(out.bits())
