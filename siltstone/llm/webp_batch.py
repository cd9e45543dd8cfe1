"""Lossless WebP files of many images at once, as arrays over all of their pixels.

All images of a call have the same width and opaque pixels; they are put together as one tall
picture. An image whose pixels have few colours gets a palette. Any other gets a predictor mode a
block, the one of ``ROW_MODES`` that costs the fewest bits, then cross-colour multipliers a block
by least squares where they save bits, and a colour cache. Runs of three pixels or more that the
image holds already become back-references. Codes come from a family made by rule, the cheapest
for each channel, so that neither writing nor reading builds a code for each image; images with a
palette have Huffman codes of their own. A file depends on its own pixels only.

``decode_many`` reads such files side by side: each step takes one symbol of every image that is
not yet complete, and the last few, longer than all others, go on by themselves.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import pairwise

import numpy as np

from siltstone.llm import webp
from siltstone.llm.webp import (
    CACHE_MULTIPLIER, CROSS_COLOUR, DISTANCE_CODES, LENGTH_CODES, PALETTE, PREDICTOR, ROW_MODES, BitWriter, blocks,
    canonical, from_above, huffman_lengths, joined, near_codes, palette_bits, prefix_symbol, riff, write_head,
    write_lengths, write_plain, write_simple,
)

#: Blocks of 32 x 32 pixels have a predictor mode and multipliers of their own.
BLOCK_BITS = 5
#: A colour cache of this many places, as a power of two.
CACHE_BITS = 5
#: Longest code of the family, so that tables to read it stay small.
CODE_LIMIT = 12
LONGEST = 4096
#: Pixels that each colour of a palette stands for, at the least and on average.
PALETTE_USES = 4
GREEN = 256 + LENGTH_CODES + (1 << CACHE_BITS)
SIZES = (GREEN, 256, 256, DISTANCE_CODES)
#: Letters from frequent to rare.
LETTERS = "etaoinsrhldcumfpgwybvkjxqz"


def _byte_weights() -> list[np.ndarray]:
    """How often bytes come in the kinds of channels that the family has a code for, out of about 2 ** 16."""
    text = np.full(256, 4.0)
    text[32:127] = 60
    text[48:58] = 200
    text[[10, 44, 46]] = 700
    text[32] = 9000
    for k, letter in enumerate(LETTERS):
        text[ord(letter)] = 6500 * 0.87**k
        text[ord(letter.upper())] = 400 * 0.87**k
    text[0x80:0xC0] = 40
    text[[0xC3, 0xE2]] = 600, 60
    wide = text / 4  # scripts of two and three bytes a character
    wide[0x80:0xC0] = 700
    wide[[0xCE, 0xCF, 0xD0, 0xD1, 0xD7, 0xD8, 0xD9]] = 3000
    wide[0xE0:0xF0] = 1200
    distance = np.minimum(np.arange(256), 256 - np.arange(256))
    small = 16000 * 0.88**distance + 1  # what prediction leaves
    return [text, wide, small, np.full(256, 256.0)]


@lru_cache(maxsize=1)
def code_family() -> list[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """By channel (green, red, blue, distance): code lengths and codes of each kind, and how they are written."""
    out = []
    for size in SIZES:
        lengths, codes, written = [], [], []
        if size == DISTANCE_CODES:
            weights = [np.full(size, 1.0)]
        else:
            weights = _byte_weights()
        if size == GREEN:
            runs = 400 * 0.7 ** np.arange(LENGTH_CODES) + 1
            weights = [np.concatenate([w, runs, np.full(1 << CACHE_BITS, 120.0)]) for w in weights]
        for w in weights:
            n = huffman_lengths(np.rint(w * 16).astype(int).tolist(), CODE_LIMIT)
            order, bits, code = canonical(n)
            head = BitWriter()
            write_lengths(head, n)
            table = np.zeros(size, dtype=np.int64)
            table[order] = code
            lengths.append(n)
            codes.append(table)
            written.append((head.value, head.n))
        out.append((np.array(lengths), np.stack(codes), written))
    return out


def encode_rows(payloads: list[bytes], width: int) -> list[bytes]:
    """A file of each payload: rows of ``width`` opaque pixels from their red, green and blue bytes."""
    if not payloads:
        return []
    heights = np.array([len(p) // (3 * width) for p in payloads])
    rgb = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, width, 3)
    owner = np.repeat(np.arange(len(payloads)), heights)
    starts = np.cumsum(heights) - heights
    value = rgb[..., 0].astype(np.int64) << 16 | rgb[..., 1].astype(np.int64) << 8 | rgb[..., 2]
    colours, index = np.unique(owner[:, None] << 24 | value, return_inverse=True)
    index = index.reshape(value.shape)
    colour_ends = np.searchsorted(colours >> 24, np.arange(len(payloads) + 1))
    pixels = heights * width
    small = (np.diff(colour_ends) <= 256) & (np.diff(colour_ends) * PALETTE_USES <= pixels)

    heads: list[BitWriter] = []
    streams: list[np.ndarray] = []
    widths: list[int] = []
    rest = np.flatnonzero(~small)
    chosen = np.flatnonzero(~small[owner])
    modes, elements, residue = _transformed(rgb[chosen], heights[rest], width) if len(rest) else ([], [], None)
    nth = dict(zip(rest.tolist(), range(len(rest)), strict=True))
    ends = np.cumsum(heights[rest])
    for k, high in enumerate(heights.tolist()):
        out = BitWriter()
        write_head(out, width, high)
        if small[k]:
            a, b = colour_ends[k], colour_ends[k + 1]
            palette = (colours[a:b] & 0xFFFFFF).astype(np.uint32) | np.uint32(0xFF000000)
            rows = index[starts[k] : starts[k] + high] - a
            stream, wide = _with_palette(out, palette, rows, width)
        else:
            n = nth[k]
            for kind, table in ((PREDICTOR, modes[n]), (CROSS_COLOUR, elements[n])):
                out.write(1 | kind << 1 | (BLOCK_BITS - 2) << 3, 6)
                write_plain(out, table)
            stream, wide = residue[ends[n] - high : ends[n]].reshape(-1), width
        out.write(0, 1)  # no more transforms
        heads.append(out)
        streams.append(stream)
        widths.append(wide)
    return _entropy_coded(heads, streams, widths, ~small)


def _with_palette(out: BitWriter, palette: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Writes the palette; the rows of its numbers, bundled where it is small."""
    out.write(1 | PALETTE << 1 | (len(palette) - 1) << 3, 11)
    write_plain(out, joined(np.diff(webp.channels(palette), axis=0, prepend=0)))
    power = palette_bits(len(palette))
    narrow = blocks(width, power)
    wide = np.zeros((len(rows), narrow << power), dtype=np.uint32)
    wide[:, :width] = rows
    packed = np.zeros((len(rows), narrow), dtype=np.uint32)
    for k in range(1 << power):
        packed |= wide[:, k :: 1 << power] << np.uint32((8 >> power) * k)
    return (np.uint32(0xFF000000) | packed << np.uint32(8)).reshape(-1), narrow


def _transformed(rgb: np.ndarray, heights: np.ndarray, width: int):
    """Predictor modes and cross-colour elements of each image as small pictures, and what they leave as pixels."""
    first = np.zeros(len(rgb), dtype=bool)
    starts = np.cumsum(heights) - heights
    first[starts] = True
    above = np.empty((len(rgb), width + 2, 3), dtype=np.uint8)  # as the decoder holds it, one place later
    above[1:, 1:-1] = rgb[:-1]
    above[first] = 0
    above[:, 0] = above[:, 1]
    above[:, -1] = rgb[:, 0]
    # blocks of rows start anew with each image
    tall = blocks(heights, BLOCK_BITS)
    row = np.arange(len(rgb)) - np.repeat(starts, heights)
    block_row = np.repeat(np.cumsum(tall) - tall, heights) + (row >> BLOCK_BITS)
    cuts = np.flatnonzero(np.diff(block_row, prepend=-1))
    across = blocks(width, BLOCK_BITS)
    column = np.arange(width) >> BLOCK_BITS
    edges = np.arange(across) << BLOCK_BITS

    def by_block(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.add.reduceat(x, edges, axis=1), cuts, axis=0)

    bits = code_family()[1][0].min(axis=0).astype(np.int16)  # of a byte in its best code
    left: list[np.ndarray] = []
    costs = []
    for mode in ROW_MODES:
        guess = from_above(mode, above[:, :-2], above[:, 1:-1], above[:, 2:]) if mode else np.uint8(0)
        differ = rgb - guess
        left.append(differ)
        cost = bits[differ].reshape(len(rgb), -1)  # the three channels of a block stand side by side
        costs.append(np.add.reduceat(np.add.reduceat(cost, cuts, axis=0), 3 * edges, axis=1))
    best = np.argmin(np.stack(costs), axis=0)
    residue = np.empty_like(rgb)
    for k, (a, b) in enumerate(pairwise([*cuts.tolist(), len(rgb)])):
        for mode, c in zip(best[k].tolist(), edges.tolist(), strict=True):
            residue[a:b, c : c + (1 << BLOCK_BITS)] = left[mode][a:b, c : c + (1 << BLOCK_BITS)]
    # a first row is predicted from the left, a first column from above
    residue[first, 1:] = rgb[first, 1:] - rgb[first, :-1]
    residue[:, 0] = rgb[:, 0] - above[:, 1]
    residue[first, 0] = rgb[first, 0]

    red, green, blue = (residue[..., k].view(np.int8).astype(np.int64) for k in range(3))
    over = np.maximum(by_block(green * green), 1)
    fit = lambda x, y, z: np.clip(np.rint(32 * by_block(x * y) / z), -128, 127).astype(np.int64)
    spread = lambda t: t[block_row][:, column]

    def saving(t: np.ndarray, by: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers, nothing where they save nothing, and what they leave of ``x``."""
        new = x - (spread(t) * by >> 5) & 255
        t = np.where(by_block(bits[new]) < by_block(bits[x & 255]), t, 0)
        return t, (np.where(spread(t) != 0, new, x) + 128 & 255) - 128

    to_red, new_red = saving(fit(green, red, over), green, red)
    to_blue, blue_left = saving(fit(green, blue, over), green, blue)
    red_to_blue, new_blue = saving(fit(red, blue_left, np.maximum(by_block(red * red), 1)), red, blue_left)
    # all predictions are opaque, so nothing is left of alpha
    pixels = (new_red & 255) << 16 | (green & 255) << 8 | new_blue & 255
    numbers = np.array(ROW_MODES)[best]
    mode_pixels = (0xFF000000 | numbers << 8).astype(np.uint32)
    element_pixels = (0xFF000000 | (red_to_blue & 255) << 16 | (to_blue & 255) << 8 | to_red & 255).astype(np.uint32)
    by_image = lambda t: [t[a:b].reshape(-1) for a, b in pairwise([0, *np.cumsum(tall).tolist()])]
    return by_image(mode_pixels), by_image(element_pixels), pixels.astype(np.uint32)


def _last_like(key: np.ndarray) -> np.ndarray:
    """By place, the last place before with an equal key, or -1. Keys are not negative; small ones sort faster."""
    if key.max(initial=0) < 1 << 16:
        key = key.astype(np.uint16)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    last = np.full(len(key), -1, dtype=np.int64)
    last[order[1:][same]] = order[:-1][same]
    return last


#: Bits of a hash of three pixels, of which two that differ in one image may share one: the later then is no reference.
HASH_BITS = 37
#: Bits left for a place in an image.
PLACE_BITS = 14


def _last_in_image(mixed: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """By place, the last place before in the same image with an equal hash of ``HASH_BITS``, or -1."""
    starts = np.concatenate([[0], ends[:-1]])
    if len(ends) > 1 << 64 - HASH_BITS - PLACE_BITS or (ends - starts).max() > 1 << PLACE_BITS:
        order = np.lexsort((mixed, owner))
        same = (mixed[order[1:]] == mixed[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    else:  # image, hash and place as one number, so that numbers are sorted and not places
        place = (np.arange(len(owner)) - starts[owner]).astype(np.uint64)
        key = np.sort(owner.astype(np.uint64) << np.uint64(HASH_BITS + PLACE_BITS) | mixed << np.uint64(PLACE_BITS) | place)
        order = (key & np.uint64((1 << PLACE_BITS) - 1)).view(np.int64) + starts[(key >> np.uint64(HASH_BITS + PLACE_BITS)).view(np.int64)]
        key >>= np.uint64(PLACE_BITS)
        same = key[1:] == key[:-1]
    last = np.full(len(owner), -1, dtype=np.int64)
    last[order[1:][same]] = order[:-1][same]
    return last


def _references(pixels: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs that their own image holds before, from left to right."""
    n = len(pixels)
    if n < 3:
        return []
    owner = np.searchsorted(ends, np.arange(n), side="right")
    p = pixels.astype(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        mixed[: n - 2] += p[k : n - 2 + k] * np.uint64(odd)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    last = _last_in_image(mixed >> np.uint64(64 - HASH_BITS), owner, ends)
    at = np.flatnonzero(last >= 0)
    at = at[at < n - 2]
    before = last[at]
    real = (owner[before] == owner[at]) & (owner[at] == owner[np.minimum(at + 2, n - 1)])
    for k in range(3):
        real &= pixels[before + k] == pixels[at + k]
    at, before = at[real], before[real]
    if not len(at):
        return []
    # places that follow each other at one distance are parts of one run
    distance = at - before
    breaks = np.append(np.flatnonzero((np.diff(at) != 1) | (np.diff(distance) != 0)), len(at) - 1)
    length = at[breaks[np.searchsorted(breaks, np.arange(len(at)))]] + 3 - at
    found, k = [], 0
    places, lengths, distances = at.tolist(), length.tolist(), distance.tolist()
    following = np.searchsorted(at, at + np.minimum(length, LONGEST)).tolist()
    while k < len(places):
        found.append((places[k], min(lengths[k], LONGEST), distances[k]))
        k = following[k]
    return found


def _bits_of(value: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The bits of numbers of 1 to 63 bits, one after another and the lowest first."""
    end = np.cumsum(width)
    at = end - width
    if not len(at):
        return np.zeros(0, dtype=np.uint8)
    words = np.zeros((int(end[-1]) >> 6) + 2, dtype="<u8")
    value, turn, word = value.astype(np.uint64), (at & 63).astype(np.uint64), at >> 6
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(value << turn, first)
    over = np.flatnonzero((at & 63) + width > 64)  # one at most runs on into a word
    words[word[over] + 1] |= value[over] >> (np.uint64(64) - turn[over])
    return np.unpackbits(words.view(np.uint8), bitorder="little", count=int(end[-1]))


def _entropy_coded(heads: list[BitWriter], streams: list[np.ndarray], widths: list[int], cached: np.ndarray) -> list[bytes]:
    """Finished files: the heads, then each stream with its own codes, and where ``cached`` with a colour cache."""
    n = len(heads)
    pixels = np.concatenate(streams)
    ends = np.cumsum([len(s) for s in streams])
    owner = np.repeat(np.arange(n), [len(s) for s in streams])
    # one token a pixel at first, by the symbol of its green channel
    greens = (pixels >> 8 & 255).astype(np.int64)
    slot = ((pixels.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).astype(np.int64)
    last = _last_like(owner << CACHE_BITS | slot)
    again = (last >= 0) & (pixels[last] == pixels) & cached[owner]
    greens[again] = 256 + LENGTH_CODES + slot[again]
    keep = np.ones(len(pixels), dtype=bool)
    runs = []
    for at, length, distance in _references(pixels, ends):
        keep[at + 1 : at + length] = False
        s, more, more_bits = prefix_symbol(length)
        t, far, far_bits = prefix_symbol(near_codes(widths[owner[at]]).get(distance, distance + len(webp.NEAR)))
        greens[at] = 256 + s
        runs.append((more, more_bits, t, far, far_bits))
    pixels, greens, owner = pixels[keep], greens[keep], owner[keep]
    literal = np.flatnonzero(greens < 256)
    run = np.flatnonzero((greens >= 256) & (greens < 256 + LENGTH_CODES))
    more, more_bits, distances, far, far_bits = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    channels = [  # places among the tokens, and symbols there
        (slice(None), greens),
        (literal, (pixels[literal] >> 16 & 255).astype(np.int64)),
        (literal, (pixels[literal] & 255).astype(np.int64)),
        (run, distances),
    ]
    kinds, tables, lengths_of = [], [], []  # of each channel: the code by image, codes, their lengths
    own = np.flatnonzero(~cached)
    for k, ((where, symbols), size, (lengths, codes, written)) in enumerate(zip(channels, SIZES, code_family(), strict=True)):
        counts = np.bincount(owner[where] * size + symbols, minlength=n * size).reshape(n, size)
        kinds.append(np.argmin(counts @ lengths.T, axis=1))
        tables.append(np.concatenate([codes, np.zeros((len(own), size), np.int64)]))
        lengths_of.append(np.concatenate([lengths, np.zeros((len(own), size), np.int64)]))
        for j, i in enumerate(own.tolist(), len(written)):
            kinds[k][i] = j
            upto = 256 + LENGTH_CODES if k == 0 else size
            made = huffman_lengths(counts[i, :upto].tolist())
            order, bits, code = canonical(made)
            tables[k][j, order], lengths_of[k][j, order] = code, bits
            written = [*written, made]
        kinds[k] = kinds[k].tolist(), written
    for i, head in enumerate(heads):
        head.write(1 | CACHE_BITS << 1 if cached[i] else 0, 5 if cached[i] else 1)
        head.write(0, 1)  # one group of codes
        for k, (chosen, written) in enumerate(kinds):
            if k == 3:
                write_simple(head, 0 if cached[i] else 255)  # alpha, which comes before the distances
            how = written[chosen[i]]
            head.write(*how) if cached[i] else write_lengths(head, how)
    kind_of = [np.array(chosen) for chosen, _ in kinds]
    # each token's bits as one number: at most 12 + 12 + 12 of a pixel, 15 + 11 + 15 + 20 of a run
    value, width = np.zeros(len(greens), dtype=np.int64), np.zeros(len(greens), dtype=np.int64)

    def add(where, what: np.ndarray, bits: np.ndarray) -> None:
        value[where] |= what << width[where]
        width[where] += bits

    for k, (where, symbols) in enumerate(channels):
        which = kind_of[k][owner[where]]
        if k == 3:
            add(run, more, more_bits)
        add(where, tables[k][which, symbols], lengths_of[k][which, symbols])
    add(run, far, far_bits)
    bit_ends = np.concatenate([[0], np.cumsum(width)])[np.searchsorted(owner, np.arange(n + 1))]
    some = width > 0
    value, width = value[some], width[some]
    bits = _bits_of(value, width)
    return [riff(np.concatenate([head.bits(), bits[a:b]])) for head, (a, b) in zip(heads, pairwise(bit_ends.tolist()), strict=True)]


#: With fewer images than this left, each goes on by itself.
FEW = 24
#: With fewer back-references than this in a step, each is read by itself.
FEW_RUNS = 5
#: Steps between two looks at which images are complete.
STRIDE = 16


def decode_many(files: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """``webp.decode`` of each file; images of one group of codes and one alpha side by side."""
    opened = [webp.Opened(f) for f in files]
    plain = [k for k, o in enumerate(opened) if o.coded.meta is None and o.coded.codes[0][3].width == 0]
    coded: dict[int, np.ndarray] = {}
    if len(plain) >= FEW:
        coded = dict(zip(plain, _side_by_side([opened[k].coded for k in plain]), strict=True))
    return [
        (o.width, o.height, o.inverted(coded[k] if k in coded else o.coded.pixels())) for k, o in enumerate(opened)
    ]


class _Tables:
    """The tables of many codes as one, with the place and mask of each image's own; entries are value * 16 + bits."""

    def __init__(self, codes: list[webp.PrefixCode]):
        at: dict[int, int] = {}
        parts, size = [], 0
        for code in codes:
            if id(code) not in at:
                at[id(code)] = size
                parts.append(code.by_bits << 4 | np.array(code.sizes))
                size += len(code.by_bits)
        self.entries = np.concatenate(parts)
        self.base = np.array([at[id(c)] for c in codes])
        self.mask = np.array([c.mask for c in codes], dtype=np.uint64)


_NEAR_X, _NEAR_Y = np.array(webp.NEAR).T


def _prefix_values(symbols: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``webp.prefix_value`` of each symbol with the bits that follow it, and how many of these it takes."""
    extra = np.maximum((symbols - 2) >> 1, 0)
    more = (window & ((np.uint64(1) << extra.view(np.uint64)) - np.uint64(1))).view(np.int64)
    return np.where(symbols < 4, symbols + 1, ((2 + (symbols & 1)) << extra) + more + 1), extra


def _near_distances(codes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """``webp.near_distance`` of each code."""
    k = np.minimum(codes, len(_NEAR_X)) - 1
    return np.where(codes > len(_NEAR_X), codes - len(_NEAR_X), np.maximum(1, _NEAR_X[k] + _NEAR_Y[k] * widths))


def _side_by_side(images: list[webp.Coded]) -> list[np.ndarray]:
    """Pixels of ``images``: each step reads one symbol of every image that is not complete."""
    n = len(images)
    data = [image.bits.data for image in images]
    starts = np.cumsum([0, *map(len, data)])
    # an image that is complete may be read on for a few steps
    buffer = np.frombuffer(b"".join(data) + bytes(8 * STRIDE), dtype=np.uint8)
    windows = np.ndarray(shape=(len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    sizes = np.array([image.width * image.height for image in images])
    firsts = np.cumsum(sizes + 1) - sizes - 1  # one place after each image takes what comes after its end
    out = np.zeros(int(sizes.sum()) + n, dtype=np.uint32)
    green, red, blue, far = (_Tables([image.codes[0][k] for image in images]) for k in (0, 1, 2, 4))
    across = np.array([image.width for image in images])
    cache_bits = np.array([image.cache_bits for image in images])
    cache_at = np.cumsum(1 << cache_bits) - (1 << cache_bits)
    cache = np.zeros(int((1 << cache_bits).sum()), dtype=np.uint32)
    turn = (32 - cache_bits).astype(np.uint64)
    opaque = np.array([image.codes[0][3].symbols[0] << 24 for image in images])
    at = starts[:-1] * 8 + np.array([image.bits.at for image in images])
    place, end = firsts.copy(), firsts + sizes
    multiplier, word, seven = np.uint64(CACHE_MULTIPLIER), np.uint64(0xFFFFFFFF), 7

    live = np.arange(n)
    while len(live) >= FEW:
        here, spot, last = at[live], place[live], end[live]
        gb, gm, rb, rm, bb, bm = (x[live] for t in (green, red, blue) for x in (t.base, t.mask))
        alpha, ca, ct = opaque[live], cache_at[live], turn[live]
        for _ in range(STRIDE):
            window = windows[here >> 3] >> (here & seven).astype(np.uint64)
            g = green.entries[gb + (window & gm).view(np.int64)]
            bits, s = g & 15, g >> 4
            window >>= bits.view(np.uint64)
            r = red.entries[rb + (window & rm).view(np.int64)]
            more = r & 15
            window >>= more.view(np.uint64)
            b = blue.entries[bb + (window & bm).view(np.int64)]
            pixel = alpha | r >> 4 << 16 | s << 8 | b >> 4
            step = bits + more + (b & 15)
            move = spot < last
            step *= move
            odd = np.flatnonzero((s >= 256) & move)
            runs: list[int] = []
            if len(odd):
                known = odd[s[odd] >= 256 + LENGTH_CODES]
                if (cache_bits[live[known]] == 0).any():
                    raise ValueError("no colour cache")
                pixel[known] = cache[ca[known] + s[known] - 256 - LENGTH_CODES]
                step[odd] = bits[odd]
                runs = odd[s[odd] < 256 + LENGTH_CODES].tolist()
                move[runs] = False
            kept = out[spot[runs]] if runs else None
            out[spot] = pixel
            slot = ca + ((pixel.view(np.uint64) * multiplier & word) >> ct).view(np.int64)
            if runs:
                out[spot[runs]] = kept
                going = np.ones(len(live), dtype=bool)
                going[runs] = False
                cache[slot[going]] = pixel[going]
            else:
                cache[slot] = pixel
            here += step
            spot += move
            if len(runs) >= FEW_RUNS:
                k, a, there = live[runs], spot[runs], here[runs]
                window = windows[there >> 3] >> (there & seven).astype(np.uint64)  # holds all of a reference, 43 bits at most
                length, took = _prefix_values(s[runs] - 256, window)
                window >>= took.view(np.uint64)
                t = far.entries[far.base[k] + (window & far.mask[k]).view(np.int64)]
                code, more = _prefix_values(t >> 4, window >> (t & 15).view(np.uint64))
                distance = _near_distances(code, across[k])
                if ((distance > a - firsts[k]) | (length > last[runs] - a)).any():
                    raise ValueError("a back-reference leaves the image")
                here[runs] = there + took + (t & 15) + more
                spot[runs] = a + length
                of = np.repeat(np.arange(len(k)), length)
                nth = np.arange(len(of)) - (np.cumsum(length) - length)[of]
                copied = out[(a - distance)[of] + nth % distance[of]]
                out[a[of] + nth] = copied
                slots = (copied.astype(np.uint64) * multiplier & word) >> turn[k][of]
                cache[cache_at[k][of] + slots.view(np.int64)] = copied  # of equal places the last one stays
                runs = []
            for i in runs:
                k = int(live[i])
                image = images[k]
                reader = image.bits
                reader.at = int(here[i]) - 8 * int(starts[k])
                length = webp.prefix_value(reader, int(s[i]) - 256)
                distance = webp.near_distance(webp.prefix_value(reader, image.codes[0][4].read(reader)), image.width)
                here[i] = reader.at + 8 * int(starts[k])
                a = int(spot[i])
                if distance > a - firsts[k] or length > last[i] - a:
                    raise ValueError("a back-reference leaves the image")
                if distance >= length:
                    out[a : a + length] = out[a - distance : a - distance + length]
                else:
                    out[a : a + length] = np.resize(out[a - distance : a], length)
                spot[i] += length
                if image.cache_bits:
                    copied = out[a : a + length]
                    slots = (copied.astype(np.uint64) * multiplier & word) >> turn[k]
                    cache[cache_at[k] + slots.view(np.int64)] = copied  # of equal places the last one stays
        at[live], place[live] = here, spot
        if (here > 8 * starts[live + 1]).any():
            raise ValueError("the image ends too early")
        live = live[spot < last]
    for k in live.tolist():
        image, a, b = images[k], int(firsts[k]), int(place[k])
        image.bits.at = int(at[k]) - 8 * int(starts[k])
        held = cache[cache_at[k] : cache_at[k] + (1 << image.cache_bits)].tolist()
        done = webp.read_pixels(image.bits, image.codes[0], image.width, int(sizes[k]), image.cache_bits, held, out[a:b].tolist())
        out[a : a + len(done)] = done
    return [out[a : a + m] for a, m in zip(firsts.tolist(), sizes.tolist(), strict=True)]
