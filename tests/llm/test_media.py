"""The WebP codec by exact round trips over its features, and the media columns."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import media, webp, webp_batch
from siltstone.llm.media import from_media, media_features, payload, split_files, store_media, to_media

#: A one-pixel lossless file as published for feature detection.
ONE_PIXEL = "UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="


def picture(seed, width, height, colours=None):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**32, size=colours or width * height, dtype=np.uint32)
    out = base[rng.integers(0, len(base), size=width * height)]
    out[: width * height // 3] = out[0]  # something to refer back to
    out[-width * 2 :] = out[: width * 2] if height > 3 else out[-width * 2 :]
    return out


def test_a_published_file():
    width, height, pixels = webp.decode(base64.b64decode(ONE_PIXEL))
    assert (width, height, len(pixels)) == (1, 1, 1)


ALL = [(), *((k,) for k in range(4)), *itertools.permutations((0, 1, 2), 3), (3, 0), (2, 1)]


@pytest.mark.parametrize("transforms", ALL)
@pytest.mark.parametrize(("cache_bits", "references"), [(0, False), (0, True), (4, True), (11, False)])
def test_round_trip(transforms, cache_bits, references):
    for seed, (width, height) in enumerate([(1, 1), (7, 5), (13, 9), (1, 12), (33, 3)]):
        for colours in (1, 2, 3, 13, 200):
            pixels = picture(seed, width, height, colours)
            if 3 in transforms and len(np.unique(pixels)) > 256:
                continue
            data = webp.encode(pixels, width, height, transforms, cache_bits=cache_bits, references=references)
            w, h, got = webp.decode(data)
            assert (w, h) == (width, height)
            assert (got == pixels).all(), (transforms, width, height, colours)


def test_each_predictor():
    pixels = picture(5, 11, 8)
    for mode in range(14):
        data = webp.encode(pixels, 11, 8, (webp.PREDICTOR,), modes=(mode,))
        assert (webp.decode(data)[2] == pixels).all(), mode


def test_meta_codes_and_repeated_lengths():
    """Two groups of codes by block, and code lengths with runs, written bit by bit."""
    out = webp.BitWriter()
    webp.write_head(out, 8, 4)
    out.write(0, 1)  # no transform
    out.write(0, 1)  # no cache
    out.write(1, 1)  # several groups, by blocks of 4 x 4
    out.write(0, 3)
    webp.write_image(out, np.array([0 << 8, 1 << 8], dtype=np.uint32), 2, False)
    def run_code(symbol_runs):
        out.write(0, 1)
        out.write(15, 4)
        lengths = [0] * 19
        for s in (1, 17, 18, 16):
            lengths[s] = 2
        for i in webp.CODE_LENGTH_ORDER:
            out.write(lengths[i], 3)
        out.write(0, 1)
        codes = webp.codes_of(tuple(lengths))
        for s, extra, n in symbol_runs:
            webp.write_symbol(out, codes, s)
            out.write(extra, n)
    for green in (10, 20):
        # zeros up to the value, two ones, zeros to the end (280 lengths)
        rest = 280 - green - 2
        runs = [(17, green - 3, 3)] if green <= 10 else [(18, green - 11, 7)]
        runs += [(1, 0, 0), (1, 0, 0)]
        while rest > 138:
            runs.append((18, 127, 7))
            rest -= 138
        runs.append((18, rest - 11, 7))
        run_code(runs)
        for lone in (1, 2, 255, 0):
            lengths = [0] * 256
            lengths[lone] = 1
            webp.write_lengths(out, lengths)
    want = []
    for y in range(4):
        for x in range(8):
            bit = (x * 3 + y) & 1
            out.write(bit, 1)
            want.append(255 << 24 | 1 << 16 | ((10 if x < 4 else 20) + bit) << 8 | 2)
    assert webp.decode(webp.riff(out.bits()))[2].tolist() == want


def row_payloads(seed):
    """Rows of 64 pixels that repeat, change a little, follow a gradient, or hold any bytes."""
    rng = np.random.default_rng(seed)
    row = rng.integers(0, 256, 192, dtype=np.uint8)
    grey = np.repeat(rng.integers(0, 256, 640, dtype=np.uint8), 3)
    return [
        bytes(192),
        row.tobytes() * 70,
        np.stack([np.roll(row, 3 * k) + np.uint8(k) for k in range(40)]).tobytes(),
        (np.arange(192 * 33, dtype=np.uint32) // 7).astype(np.uint8).tobytes(),
        rng.integers(0, 256, 192 * 50, dtype=np.uint8).tobytes(),
        (grey + np.tile(np.array([0, 9, 30], np.uint8), 640)).tobytes(),
        payload("the same words again and again, " * 400)[1],
        payload("".join(chr(c) for c in rng.integers(32, 0x3000, 4000)))[1],
    ]


def test_many_images_at_once():
    payloads = [p for seed in range(8) for p in row_payloads(seed)]
    files = webp_batch.encode_rows(payloads, 64)
    assert [webp_batch.encode_rows([p], 64)[0] for p in payloads] == files  # whatever stands beside
    for k, (width, height, pixels) in enumerate(webp_batch.decode_many(files)):
        assert (width, height) == (64, len(payloads[k]) // 192)
        assert (pixels >> 24 == 255).all()
        assert np.stack([(pixels >> s).astype(np.uint8) for s in (16, 8, 0)], axis=1).tobytes() == payloads[k]
        assert (webp.decode(files[k])[2] == pixels).all()  # alone as well
    assert webp_batch.encode_rows([], 64) == [] and webp_batch.decode_many([]) == []


def test_damage_raises_among_many():
    files = webp_batch.encode_rows([p for seed in range(5) for p in row_payloads(seed)], 64)
    cut = max(files, key=len)
    short = webp.riff(np.unpackbits(np.frombuffer(cut[20 : len(cut) // 2], np.uint8), bitorder="little"))
    with pytest.raises(ValueError, match="too early|leaves"):
        webp_batch.decode_many([*files, short])


def test_codes_of_the_family_are_complete_and_hold_every_value():
    for lengths, _, _ in webp_batch.code_family():
        assert (lengths > 0).all() and lengths.max() <= webp_batch.CODE_LIMIT
        assert ((2.0**-lengths).sum(axis=1) == 1).all()


def uses(files):
    """What the files use: transforms that change something, cached pixels, back-references."""
    found = Counter()
    for f in files:
        opened = webp.Opened(f)
        for kind, _, table, _ in opened.transforms:
            modes = set(((table >> 8) & 15).tolist()) if kind == webp.PREDICTOR else set()
            found["predictor"] += bool(modes - {0})
            found["cross-colour"] += kind == webp.CROSS_COLOUR and bool((table & 0xFFFFFF).any())
            found["palette"] += kind == webp.PALETTE
        green, far = opened.coded.codes[0][0], opened.coded.codes[0][4]
        seen = Counter()
        read = green.by_bits.tolist()
        green.symbols = Seen(read, seen)
        try:
            opened.coded.pixels()
        finally:
            green.symbols = read
        found["cache"] += any(s >= 256 + webp.LENGTH_CODES for s in seen)
        found["references"] += any(256 <= s < 256 + webp.LENGTH_CODES for s in seen) and far is not None
        found["files"] += 1
    return found


class Seen(list):
    def __init__(self, values, seen):
        super().__init__(values)
        self.seen = seen

    def __getitem__(self, k):
        s = super().__getitem__(k)
        self.seen[s] += 1
        return s


def test_files_of_the_query_carry_every_part_of_the_format(spark):
    stored = store_media(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = uses([f for r in stored.select("media").collect() for f in split_files(bytes(r.media))])
    assert found["files"] >= 1000
    for part in ("predictor", "cross-colour", "palette", "cache", "references"):
        assert found[part] > 0, found


def test_damage_raises():
    good = to_media([payload("some text " * 40)[1]])[0]
    for bad in (good[:20], good[:-40], b"RIFF" + good[4:12] + b"VP8 " + good[16:]):
        with pytest.raises(ValueError):
            from_media([bad])


TEXTS = [None, "", "a", "x" * 192, "y" * 193, "Ünï 🙂\n" * 50, "".join(map(chr, range(1, 700))), "the end " * 60_000]


def test_media_columns(spark):
    rng = random.Random(1)
    rows = [(i if i else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    rows += [(100 + i, "".join(rng.choices("abc déf.\n", k=rng.randint(0, 3000)))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    got = media_features(store_media(docs)).collect()
    want = []
    for i, t in rows:
        n, data = payload(t)
        assert len(data) % 192 == 0 and data[:n] == (t or "").encode()
        want.append((str(i), n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        by_text.setdefault((r.n_bytes, r.payload_sha256), set()).add((bytes(r.media), r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert media_features(store_media(docs.limit(0))).count() == 0


def test_long_payloads_are_stored_as_several_files():
    rng = random.Random(2)
    n, data = payload("".join(rng.choices("abc def\n", k=192 * 600 - 5)))
    stored = to_media([payload("before")[1], data, payload("after")[1]])
    assert [len(split_files(m)) for m in stored] == [1, 3, 1]
    found = from_media(stored)
    assert [x[2].tobytes() for x in found] == [payload("before")[1], data, payload("after")[1]]
    assert found[1][:2] == (64, 600) and stored[1] == to_media([data])[0]
    assert list(media.slices([5, 5, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4)] and list(media.slices([], 10)) == []


def test_references_of_many_images_are_read_together(monkeypatch):
    rng = random.Random(7)
    made = []
    for _ in range(64):
        words = [bytes(rng.choices(range(97, 123), k=rng.randint(6, 12))) for _ in range(40)]
        made.append(b" ".join(rng.choices(words, k=3000))[: 192 * 24])
    files = webp_batch.encode_rows(made, 64)
    want = [webp.decode(f) for f in files]
    calls = []
    read = webp.prefix_value
    monkeypatch.setattr(webp, "prefix_value", lambda *a: calls.append(a) or read(*a))
    got = webp_batch.decode_many(files)
    assert len(calls) < 1000  # 28,548 when each was read by itself
    for (w, h, p), (a, b, q), data in zip(got, want, made, strict=True):
        assert (w, h) == (a, b) and (p == q).all()
        assert p.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].tobytes() == data


def test_bits_of_numbers_of_any_width():
    rng = random.Random(3)
    width = np.array([rng.randint(1, 63) for _ in range(500)] + [64 - 1, 1, 63, 63])
    value = np.array([rng.getrandbits(int(n)) for n in width], dtype=np.int64)
    want = [v >> b & 1 for v, n in zip(value.tolist(), width.tolist(), strict=True) for b in range(n)]
    assert webp_batch._bits_of(value, width).tolist() == want
    assert webp_batch._bits_of(value[:0], width[:0]).tolist() == []


def test_a_place_before_is_found_alike_in_few_and_in_many_images(monkeypatch):
    rng = np.random.default_rng(1)
    ends = np.cumsum(rng.integers(1, 90, 60))
    owner = np.repeat(np.arange(60), np.diff(ends, prepend=0))
    mixed = rng.integers(0, 12, len(owner)).astype(np.uint64)
    packed = webp_batch._last_in_image(mixed, owner, ends).tolist()
    want = [max((j for j in range(i) if owner[j] == owner[i] and mixed[j] == mixed[i]), default=-1) for i in range(len(owner))]
    assert packed == want
    monkeypatch.setattr(webp_batch, "PLACE_BITS", 3)
    assert webp_batch._last_in_image(mixed, owner, ends).tolist() == want
