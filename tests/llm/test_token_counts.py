"""Trie-shared counts against a search over all cuts of each word by itself."""

import math
import random
import re
from functools import cache

import public_tokenizers

from siltstone.llm.token_counts import BYTE_SCORE, MARK, WordCounts, token_counts, zipf_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain(word):
    pieces, _ = zipf_pieces(MODEL)
    text = MARK + word

    @cache
    def best(end):
        if end == 0:
            return (0.0, 0)
        ways = []
        for start in range(end):
            part = text[start:end]
            if part in pieces:
                s, n = best(start)
                ways.append((s + pieces[part], -(n + 1)))
            elif start == end - 1:
                s, n = best(start)
                k = len(part.encode())
                ways.append((s + k * BYTE_SCORE, -(n + k)))
        s, n = max(ways)
        return (s, -n)

    return best(len(text))


def test_counts_match_each_word_by_itself(spark):
    rng = random.Random(2)
    words = ["token", "tokens", "tokenize", "Tokenization", "é", "🙂", "日本語", "a" * 90, "x y", "don't", "▁"]
    words += ["".join(rng.choices("abceinorst", k=rng.randint(1, 14))) for _ in range(200)]
    texts = [None, "", " \n\t", *(" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)), "word " * 3000]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS score")
    got = {r.doc_id: r for r in token_counts(docs, MODEL).collect()}
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = [plain(w) for w in ws]
        r = got[i if i else None]
        assert (r.n_words, r.n_tokens) == (len(ws), sum(n for _, n in want))
        assert math.isclose(r.score, math.fsum(s for s, _ in want), abs_tol=1e-9)
    assert token_counts(docs.limit(0), MODEL).count() == 0


def test_counts_do_not_depend_on_what_was_kept(monkeypatch):
    texts = ["one two three", "two tree trees", "one tree " * 5]
    fresh = [WordCounts(MODEL).count([t])[0] for t in texts]
    kept = WordCounts(MODEL)
    monkeypatch.setattr("siltstone.llm.token_counts.KEPT_WORDS", 2)
    assert [kept.count([t])[0] for t in texts] == fresh
    assert WordCounts(MODEL).count(texts) == fresh
