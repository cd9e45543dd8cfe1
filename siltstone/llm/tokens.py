"""Encoding with the tokenizers library, once per distinct white-space chunk.

Both vocabularies' pre-tokenizers end a pre-token wherever white space starts, so a text's ids are
those of its chunks put together (tests hold this against whole-text encoding). Chunks repeat far
more than texts do; each worker keeps a bounded cache of their ids as little-endian unsigned
32-bit bytes. Chunks of many texts are cut, told apart and replaced by their ids as arrays, so that
only distinct ones are Python objects. A text that holds the string of an added token, such as an
end-of-text mark, goes through the library as a whole and gets that token's id.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import batched
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    import pyarrow as pa

#: White space as Unicode has it (fixed values of the White_Space property).
SPACE = r"\t-\r \x85\xa0  -     　"
#: Chunks of byte-level BPE: a run of other characters with one space before it, or white space;
#: the last character of white space before a run belongs to what follows.
BYTE_LEVEL = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Chunks where white space only separates; one space before a chunk is left with it, as it changes no id.
WORD_LEVEL = rf"[^{SPACE}]+"

#: The bytes of white space: ASCII's, and longer characters'.
ASCII_SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
LONG_SPACE = re.compile("|".join(c for c in map(chr, range(128, 0x3001)) if re.match(f"[{SPACE}]", c)).encode())

#: ASCII letters, and ASCII marks that start a pre-token wherever they follow a letter (an apostrophe may not).
ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
ASCII_MARK = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))
#: A word of Latin-1 letters, which normalisation only lower-cases.
PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Byte-level vocabularies name the bytes that do not print, in order, by the characters from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_NAMES = {b: 256 + k for k, b in enumerate(_HIDDEN)}
#: What the bytes of the characters that plain words have are named.
PLAIN_NAMES = {c: c.encode().decode("latin-1").translate(BYTE_NAMES) for c in map(chr, range(256)) if PLAIN.fullmatch(c) or c == " "}

CACHE_CHUNKS = 500_000
SLICE_CHARS = 6 << 20
ENCODE_CHUNKS = 10_000
LONG_CHUNK = 256  # characters; longer ones are encoded, but not kept
JOINED_WORDS = 16


def chunk_starts(data: bytes, first: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts that stand one after another in UTF-8, each from a place in ``first``.

    Chunks are those of ``BYTE_LEVEL``, cut again where a mark follows a Latin-1 letter: words with and without marks are one.
    """
    codes = np.frombuffer(data, np.uint8)
    space = ASCII_SPACE[codes]
    if not data.isascii():
        for m in LONG_SPACE.finditer(data):
            space[m.start() : m.end()] = True
    starts = np.zeros(len(codes), bool)
    starts[1:] = space[1:] & ~space[:-1]
    letter = ASCII_LETTER[codes]
    letter[1:] |= (codes[:-1] == 0xC3) & (codes[1:] != 0x97) & (codes[1:] != 0xB7)  # but for the signs of times and division
    starts[1:] |= ASCII_MARK[codes[1:]] & letter[:-1]
    top = np.zeros(len(codes), bool)
    top[first[first < len(codes)]] = True
    after = np.flatnonzero(space[:-1] & ~space[1:] & ~top[1:]) + 1  # a run of others after white space
    last = after - 1
    for _ in range(2):  # to the first byte of that white space's last character
        last -= codes[last] >> 6 == 2
    starts[last] = True
    starts[after[codes[after - 1] != 32]] = True
    return np.flatnonzero(starts | top)


class ChunkEncoder:
    """Ids of texts as bytes, four a token."""

    def __init__(self, vocabulary: str, chunk_pattern: str):
        # a task has one core; threads of the library's own would take those of the tasks beside it
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        #: Strings of added tokens; the case they stand in does not matter for sending a text the long way.
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.lower = chunk_pattern == WORD_LEVEL
        #: Cached chunks, their ids, and whether texts after those that brought them have used them.
        self.cache = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())
        self.used = np.zeros(0, bool)
        #: Whether an id's token begins with a space.
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.heads = np.zeros(max(names.values(), default=0) + 1, bool)
        self.heads[[i for name, i in names.items() if name.startswith(PLAIN_NAMES[" "])]] = True
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as the machine's own 32-bit integers, which must be little-endian")

    def _add(self, chunks: list[str]) -> list[bytes]:
        """Ids of new chunks: a plain word's from the library's model at once, others' through its whole pipeline."""
        plain = [bool(PLAIN.fullmatch(c)) for c in chunks]
        found = self._words([c for c, p in zip(chunks, plain, strict=True) if p])
        for some in batched((c for c, p in zip(chunks, plain, strict=True) if not p), ENCODE_CHUNKS):
            encoded = self.tokenizer.encode_batch_fast(list(some), add_special_tokens=False)
            found.update((c, array("I", x.ids).tobytes()) for c, x in zip(some, encoded, strict=True))
        return [found[c] for c in chunks]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of plain words. Several that begin with a space go to the model as one: where each gave a token that
        begins with a space, no merge went across two words, and merges within words do not depend on the others.
        """
        tokenize, names, found = self.tokenizer.model.tokenize, PLAIN_NAMES.__getitem__, {}

        def ids(text: str) -> list[int]:
            if text.isascii():  # its letters are their own names
                text = text.replace(" ", PLAIN_NAMES[" "])
            else:
                text = "".join(map(names, text))
            return [t.id for t in tokenize(text)]

        joined = [] if self.lower else [w for w in words if w[0] == " "]
        if joined:
            flat = array("I")
            for some in batched(joined, JOINED_WORDS):
                flat.extend(ids("".join(some)))
            at = np.flatnonzero(self.heads[np.frombuffer(flat, "<u4")]) * 4
            if len(at) == len(joined):
                held, ends = flat.tobytes(), [*at[1:].tolist(), 4 * len(flat)]
                found = {w: held[a:b] for w, a, b in zip(joined, at.tolist(), ends, strict=True)}
        for w in words:
            if w not in found:
                found[w] = array("I", ids(w.lower().removeprefix(" ") if self.lower else w)).tobytes()
        return found

    def encode(self, texts: Iterable[str | None], end: bytes) -> list[bytes]:
        """Ids of each text, then ``end``; a null text is an empty one. All texts are held at once."""
        gc.disable()  # nothing made here is cyclic, and looking for cycles walks all of the cache
        try:
            return self._encode(texts, end)
        finally:
            gc.enable()

    def _encode(self, texts: Iterable[str | None], end: bytes) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = [t or "" for t in texts]
        whole = {k for k, t in enumerate(map(str.lower, texts)) if any(a in t for a in self.added)}
        parts = [b"" if k in whole else t.encode() for k, t in enumerate(texts)]
        data = b"".join(parts)
        if self.lower:  # the pipeline's own lower-casing does the rest
            data = data.translate(ASCII_LOWER)
        first = np.cumsum([0, *map(len, parts)])
        starts = chunk_starts(data, first[:-1])
        bounds = pa.py_buffer(np.append(starts, len(data)))
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        here = coded.dictionary
        at = pc.index_in(here, value_set=self.cache)
        self.used[at.drop_null().to_numpy()] = True
        if len(self.cache) > CACHE_CHUNKS:  # what was used again stays, or of too much of that what these texts use
            known = np.zeros(len(self.cache), bool)
            known[at.drop_null().to_numpy()] = True
            stay = self.used if self.used.sum() <= CACHE_CHUNKS // 2 else known
            self.used = known
            self._keep(stay)
            at = pc.index_in(here, value_set=self.cache)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        new = here.filter(at.is_null())
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[missing] = len(self.cache) + np.arange(len(new))
        if len(new):
            made = pa.array(self._add(new.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
            self.cache, self.ids = pa.concat_arrays([self.cache, new]), pa.concat_arrays([self.ids, made])
            self.used = np.append(self.used, np.zeros(len(new), bool))
        ids = self.ids.take(pa.array(place[coded.indices.to_numpy()]))
        flat = ids.buffers()[2]  # none where no chunk has ids
        held = flat.to_pybytes() if flat else b""
        upto = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy()))[np.searchsorted(starts, first)].tolist()
        out = [held[a:b] + end for a, b in zip(upto, upto[1:], strict=False)]
        for k in whole:
            out[k] = array("I", self.tokenizer.encode(texts[k], add_special_tokens=False).ids).tobytes() + end
        short = pc.less_equal(pc.utf8_length(self.cache), LONG_CHUNK).to_numpy(zero_copy_only=False)
        if not short.all():
            self._keep(short)
        return out

    def _keep(self, which: np.ndarray) -> None:
        """Leave only these in the cache."""
        self.cache, self.ids, self.used = self.cache.filter(which), self.ids.filter(which), self.used[which]


_encoders: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(vocabulary: str, chunk_pattern: str) -> ChunkEncoder:
    """The worker's own encoder of a vocabulary file, which must be at the same path on all machines."""
    key = (vocabulary, chunk_pattern)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(vocabulary, chunk_pattern)
    return _encoders[key]


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, chunk_pattern: str, end: bytes):
    """(document ids, ids as bytes) of batches with a document id and a text, a few MB of text at a time."""
    encode = encoder(vocabulary, chunk_pattern).encode
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(docs):
            upto, held = at, 0
            while upto < len(docs) and held < SLICE_CHARS:
                held += len(texts[upto] or "")
                upto += 1
            yield docs[at:upto], encode(texts[at:upto], end)
            at = upto


def end_token(i: int) -> bytes:
    return int(i).to_bytes(4, "little")
