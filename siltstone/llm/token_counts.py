"""Token counts under a unigram model, with forward scores shared along a trie of pre-tokens.

A pre-token is a word with the vocabulary's word mark in front. The forward score at a prefix is
the best sum of piece scores over the ways to cut it into pieces, and depends on the prefix alone:
so the distinct pre-tokens of a slice of texts are inserted in a trie, in order, and every node's
score and piece count are computed once, from its ancestors. The node where a pre-token ends holds
its count; each worker keeps the counts of pre-tokens that it met, up to a bound, and a document's
count is the sum over its words. Nothing is shuffled.

The pieces are a public vocabulary's. Its own scores are merge ranks, not probabilities, so a
piece of rank r gets the log-probability of a Zipf law, ``-log(r + 1) - log(H)``. A character that
no piece spells costs one token a UTF-8 byte, at ``BYTE_SCORE`` each. Of equal scores the one with
fewer tokens wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tokens import SLICE_CHARS

if TYPE_CHECKING:
    import pyarrow as pa

MARK = "▁"
BYTE_SCORE = -25.0
KEPT_WORDS = 500_000
LONG_WORD = 64  # characters; counts of longer ones are not kept


@cache
def zipf_pieces(model_file: str) -> tuple[dict[str, float], int]:
    """Scores of the model's ordinary pieces, and the length of the longest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(sum(1 / (r + 1) for r in range(len(names))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(names)}, max(map(len, names))


class ForwardTrie:
    """Nodes in order of insertion; only the last path can be shared, as words come in order."""

    def __init__(self, pieces: dict[str, float], longest: int):
        self.pieces, self.longest = pieces, longest
        self.score, self.count = [0.0], [0]  # of the root, the empty prefix
        self.path = [0]
        self.last = ""

    def insert(self, word: str) -> tuple[int, float]:
        """Tokens and forward score of ``word``, which must not come before the last one."""
        text, path = MARK + word, self.path
        shared, most = 0, min(len(text), len(self.last))
        while shared < most and text[shared] == self.last[shared]:
            shared += 1
        del path[shared + 1 :]
        score, count, get = self.score, self.count, self.pieces.get
        for end in range(shared + 1, len(text) + 1):
            best, tokens = -math.inf, 0
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                s = get(text[start:end])
                if s is None:
                    if start < end - 1:
                        continue
                    n = len(text[start].encode("utf-8", "surrogatepass"))
                    s = n * BYTE_SCORE
                else:
                    n = 1
                at = path[start]
                total, made = score[at] + s, count[at] + n
                if total > best or (total == best and made < tokens):
                    best, tokens = total, made
            path.append(len(score))
            score.append(best)
            count.append(tokens)
        self.last = text
        return count[path[-1]], score[path[-1]]


class WordCounts:
    """A worker's terminal counts by word."""

    def __init__(self, model_file: str):
        self.pieces, self.longest = zipf_pieces(model_file)
        self.tokens: dict[bytes, int] = {}
        self.scores: dict[bytes, float] = {}

    def count(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(words, tokens, forward score) of each text."""
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # at space and bytes 9 to 13
        here = set().union(*words)
        new = here.difference(self.tokens)
        if len(self.tokens) > KEPT_WORDS:  # what these texts use stays
            keep = here - new
            self.tokens = {w: self.tokens[w] for w in keep}
            self.scores = {w: self.scores[w] for w in keep}
        trie = ForwardTrie(self.pieces, self.longest)
        for text in sorted(w.decode("utf-8", "surrogatepass") for w in new):
            w = text.encode("utf-8", "surrogatepass")
            self.tokens[w], self.scores[w] = trie.insert(text)
        tokens, scores = self.tokens.__getitem__, self.scores.__getitem__
        out = [(len(ws), sum(map(tokens, ws)), math.fsum(map(scores, ws))) for ws in words]
        for w in new:
            if len(w) > LONG_WORD:
                del self.tokens[w], self.scores[w]
        return out


@cache
def _counts(model_file: str) -> WordCounts:
    return WordCounts(model_file)


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, score), a row for each row of ``docs``.

    ``score`` is the sum of the words' forward scores. A null or wordless text has no words, no
    tokens and score 0; null and repeated ids stay as they are; other columns are left out; an
    empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        counter = _counts(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found: list[tuple[int, int, float]] = []
            some: list[str | None] = []
            held = 0
            for t in texts:
                some.append(t)
                held += len(t or "")
                if held >= SLICE_CHARS:
                    found += counter.count(some)
                    some, held = [], 0
            found += counter.count(some)
            n_words, n_tokens, score = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(score, pa.float64())],
                names=["doc_id", "n_words", "n_tokens", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_words long, n_tokens long, score double")
