"""Token files and packing: against whole-text encoding and a plain re-count."""

import random
import re
import string
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing, tokens
from siltstone.llm.packing import best_fit_decreasing, pack, solve_configurations
from siltstone.llm.token_files import token_files
from siltstone.llm.tokens import BYTE_LEVEL, WORD_LEVEL, ChunkEncoder, end_token

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    " ",
    "one  two\n\n three \t four's\r\n  ",
    "Ünïcode é é ΣΑΣ İstanbul  x y　z \x1c\x1d a\x85b",
    "<|endoftext|> plain <|startoftext|>",
    "no space<|endoftext|>around <|ENDOFTEXT|> it",
    "12 345,678 !!! don't we'll I'M ??",
    "日本語のテキスト 🙂🙂 a🙂b",
    "word " * 5000,
    "x" * 3000,
]


untouched = lru_cache(Tokenizer.from_file)


def plain(path, text, end):
    t = untouched(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize(("path", "pattern"), [(BYTE, BYTE_LEVEL), (WORD, WORD_LEVEL)])
def test_chunks_give_the_ids_of_whole_texts(path, pattern):
    enc = ChunkEncoder(path, pattern)
    t = Tokenizer.from_file(path)
    rng = random.Random(7)
    assert enc.encode(["Été, ÀÇ! naïve.; x"], b"")[0]
    alphabet = "aBÉçß ' \n\t.,1!  é́Σ🙂\x1c\x85-s"
    marks = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "a<|endoftext|>b", "<|end", "oftext|>"]
    texts = [x for x in TEXTS if x] + ["".join(rng.choices([*marks, " ", "one ", "\n", "É"], k=6)) for _ in range(200)] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    for text, got in zip(texts, enc.encode(texts, b""), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)


def test_token_files_round_trip(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(6, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest, read = token_files(docs, BYTE, 2, 50257)
    got, at = [], 0
    for r in read.orderBy("start").collect():
        assert r.start == at
        at += len(r.ids) // 4
        got.append((r.doc_id, r.ids))
    order = [(i is not None, i or 0) for i, _ in got]
    assert order == sorted(order)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(((i, np.array(plain(BYTE, t, 2), "<u4").tobytes()) for i, t in rows), key=key)
    assert manifest.agg({"n_ids": "sum"}).first()[0] == at
    assert {r.id_bytes for r in manifest.collect()} == {2}


def test_one_id_of_all_rows_is_dealt_to_several_parts(spark):
    rows = [(None if k % 2 else 7, f"text {k}") for k in range(400)]
    extra = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS ids", "3 AS part")
    manifest, read = token_files(extra, BYTE, 2, 50257)
    assert manifest.count() > 2
    assert read.count() == 400


def test_token_files_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, start string")
    assert token_files(docs, BYTE, 2, 50257)[1].count() == 0


def check_packing(rows, packed, capacity):
    by_doc = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.length, bytes(r.ids)) for r in packed)
    want = []
    for i, t in rows:
        ids = plain(WORD, t, 0)
        for at in range(0, len(ids), capacity):
            some = ids[at : at + capacity]
            want.append((i is not None, i or 0, at, len(some), np.array(some, "<u4").tobytes()))
    assert by_doc == sorted(want)
    at = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values(), default=0) <= capacity
    return len(at)


def test_pack_places_every_piece_once(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (2, "twice")]
    rows += [(100 + i, " ".join(rng.choices(["alpha", "beta", "of", "the"], k=rng.randint(0, 90)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    packed = pack(docs, WORD, 0, capacity=128).collect()
    n = check_packing(rows, packed, 128)
    assert n <= -(-sum(r.length for r in packed) // 128) * 1.02 + 1
    assert pack(docs.limit(0), WORD).count() == 0


def held(patterns, capacity=2048):
    found = {}
    for p in patterns:
        assert sum(k * a for k, a in p.lengths.items()) <= capacity
        for k, a in p.lengths.items():
            found[k] = found.get(k, 0) + a * p.count
    return found


def test_configurations_hold_each_length_and_come_close_to_the_bound():
    rng = np.random.default_rng(5)
    for n in (1, 300, 40_000):
        sizes, counts = np.unique(np.clip(rng.lognormal(6, 1, n).astype(int), 1, 2047), return_counts=True)
        histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        patterns = solve_configurations(histogram)
        assert held(patterns) == histogram
        used = sum(p.count for p in patterns)
        assert used <= sum(p.count for p in best_fit_decreasing(histogram))
        assert used <= -(-int((sizes * counts).sum()) // 2048) * 1.005 + 1
    # nothing shares a sequence, three share one, and thirds that leave no room
    for histogram in ({n: 10 for n in range(1100, 2048, 7)}, {682: 30, 4: 1}, {683: 300, 682: 10, 1366: 50}):
        patterns = solve_configurations(histogram)
        assert held(patterns) == histogram
        assert sum(p.count for p in patterns) <= sum(p.count for p in best_fit_decreasing(histogram))


def test_flat_bimodal_and_tiny_histograms():
    rng = np.random.default_rng(1)
    shapes = {
        "flat": (rng.integers(1, 2048, 20_000), 1.006, 1.002),
        "pairs": (rng.integers(683, 1400, 20_000), 1.03, 1.0),
        "bimodal": (np.concatenate([rng.normal(1300, 100, 5_000), rng.normal(500, 60, 9_000)]).astype(int), 1.06, 0.99),
    }
    for sizes, over_bound, over_fit in shapes.values():
        lengths, counts = np.unique(sizes, return_counts=True)
        histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        patterns = solve_configurations(histogram)
        assert held(patterns) == histogram
        used = sum(p.count for p in patterns)
        bound = max(int(counts[2 * lengths > 2048].sum()), -(-int(lengths @ counts) // 2048))
        assert used <= over_bound * bound
        assert used <= over_fit * sum(p.count for p in best_fit_decreasing(histogram))
    for _ in range(30):
        few = Counter(rng.choice([1, 2047, 1500, 600, 548, 1024, 683, 682, 300], int(rng.integers(1, 12))).tolist())
        patterns = solve_configurations(dict(few))
        assert held(patterns) == dict(few)
        assert sum(p.count for p in patterns) <= sum(p.count for p in best_fit_decreasing(dict(few)))
    assert sum(p.count for p in solve_configurations({2047: 3, 1: 3, 1500: 1, 600: 1, 548: 1})) == 5


@pytest.fixture(scope="module")
def sample_histogram():
    """Piece lengths of the larger sample table, and of the smaller, without whole sequences."""
    tokenizer, found = Tokenizer.from_file(WORD), {}
    for scale in ("0.01", "0.1"):
        counts = Counter()
        texts = pq.read_table(f"/root/testdata/sf{scale}/documents.parquet", columns=["text"]).column(0).to_pylist()
        for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False):
            counts[(len(e.ids) + 1) % 2048] += 1
        del counts[0]
        found[scale] = dict(counts)
    return found


def test_the_program_packs_the_sample_tables_into_the_bound(sample_histogram, monkeypatch):
    left = []
    plain_fit = packing.best_fit_decreasing
    monkeypatch.setattr(packing, "best_fit_decreasing", lambda h, *a: left.append(sum(h.values())) or plain_fit(h, *a))
    for histogram in sample_histogram.values():
        patterns = solve_configurations(histogram)
        assert held(patterns) == histogram
        assert sum(p.count for p in patterns) == -(-sum(n * c for n, c in histogram.items()) // 2048)
        assert left.pop() <= 0.05 * sum(histogram.values()) and not left


def test_fractions_cover_every_length_and_state_their_gap(sample_histogram):
    histogram = sample_histogram["0.01"]
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[n] for n in lengths.tolist()])
    found = packing.near_optimal_fractions(lengths, counts, 2048)
    cover = np.zeros(len(lengths))
    for key, x in found.amounts.items():
        assert sum(int(lengths[i]) * n for i, n in key) <= 2048
        for i, n in key:
            cover[i] += n * x
    assert np.allclose(cover, counts, rtol=1e-6)
    assert found.bound <= -(-int(lengths @ counts) // 2048)
    assert found.value <= (1 + packing.GAP) * found.bound


def test_chunks_used_again_outlast_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 40)
    enc, end = ChunkEncoder(BYTE, BYTE_LEVEL), end_token(2)
    added = []
    monkeypatch.setattr(enc, "_add", lambda some, add=enc._add: added.extend(some) or add(some))
    often = "so geht das Wort, élan."
    once = [" ".join(f"x{k}y{j}" for j in range(30)) for k in range(9)]
    texts = [often, often, once[0], often, *(t for k in range(1, 9, 2) for t in (once[k], once[k + 1], often))]
    got = [enc.encode([t], end)[0] for t in texts]
    assert added.count(" geht") == 1  # 5 when only chunks of the texts at hand outlasted a full cache
    fresh = Tokenizer.from_file(BYTE)
    assert got == [np.array([*fresh.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for t in texts]
    assert len(enc.cache) < 40 + 60


def test_words_with_and_without_marks_are_encoded_once(monkeypatch):
    enc, end = ChunkEncoder(BYTE, BYTE_LEVEL), end_token(2)
    added = []
    monkeypatch.setattr(enc, "_add", lambda some, add=enc._add: added.extend(some) or add(some))
    texts = ["ein Wort, ein Wort. Wort### Wort%%% été; été, été.x", "Wort, it's 4×, a÷. Wort's ª, 'Wort'"]
    got = enc.encode(texts, end)
    assert [c for c in added if c.strip().startswith(("Wort", "été"))].count(" Wort") == 1
    assert not {" Wort,", " Wort.", " Wort###", " Wort%%%", " été;", " été,"}.intersection(added)  # each was encoded before
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain(BYTE, t, 2) for t in texts]


@pytest.mark.parametrize(("path", "pattern"), [(BYTE, BYTE_LEVEL), (WORD, WORD_LEVEL)])
def test_marks_and_white_space_of_every_kind_in_many_texts(path, pattern):
    rng, t, enc = random.Random(11), untouched(path), ChunkEncoder(path, pattern)
    spaces = [c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{tokens.SPACE}]", c)]
    alphabet = [*string.punctuation, *"''aBzÉçß×÷ª’̸́Σ🙂日\x1c​1", "'s", "don't", "word", *spaces, *" " * 20]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(3000)]
    for some in (texts, [], [""], [" ", "\n"], ["", "x", ""]):
        for text, got in zip(some, enc.encode(some, b""), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    even = [x for x in texts if not re.search(r"[A-Za-zÉçß][!-&(-/:-@\[-`{-~]", x)]  # of which no mark cuts a word
    data = "".join(even).encode()
    first = np.cumsum([0, *(len(x.encode()) for x in even)])
    cut = np.append(tokens.chunk_starts(data, first[:-1]), len(data)).tolist()
    assert [data[a:b].decode() for a, b in zip(cut, cut[1:], strict=False)] == [c for x in even for c in re.findall(BYTE_LEVEL, x)]
