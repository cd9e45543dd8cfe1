"""The Jaccard join against all pairs of a small corpus."""

import random

import pytest

from siltstone.llm import ngram_join
from siltstone.llm.components import connected_components
from siltstone.llm.ngram_join import jaccard_components
from siltstone.llm.scratch import Scratch


def plain_sets(text, n=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(rows):
    sets = [(i, plain_sets(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    rows, texts = [], []
    for _ in range(40):
        texts.append(rng.choices(vocabulary, k=rng.randint(20, 120)) + (passage if rng.random() < 0.5 else []))
    base = rng.choices(vocabulary, k=90)
    for _ in range(120):  # a group of near copies, some of them on the edge
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
        texts.append(t)
    texts += [list(t) for t in texts[:10]] + [["Alpha", "bETA"], ["alpha", "beta"], ["x"], ["É", "é"]]
    for i, t in enumerate(texts):
        rows.append((1000 - i, rng.choice([" ", "\n", " \t"]).join(t)))
    return [*rows, (2000, None), (2001, ""), (2002, " \n"), (2003, ""), (None, "alpha beta"), (7, rows[0][1])]


@pytest.mark.parametrize(("seed", "block", "group"), [(1, 1024, 1 << 20), (2, 16, 4000)])
def test_components_match_all_pairs(spark, monkeypatch, seed, block, group):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", group)
    monkeypatch.setattr(ngram_join, "TASK_BYTES", 2 * group)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 AS n", "2 AS rep", "3 AS sig")
    got = jaccard_components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == plain_components(rows)
    assert [(r.class_id, r.component_id) for r in got if r.doc_id is None] == [(None, None)]


def test_an_id_with_two_texts_links_as_both(spark):
    a, b = ([f"{c}{k}" for k in range(60)] for c in "ab")
    near = lambda words, k: " ".join(words[:-1] + [f"end{k}"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 2)), (3, near(b, 3)), (4, near(a, 4)), (5, near(a, 5)), (6, near(a, 6))]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.component_id for r in got] == [1] * 7


def test_links_are_counted_and_long_texts_are_whole(spark):
    rows = corpus(3) + [(5000, "long " + " ".join(f"v{k}" for k in range(60_000)))]
    rows.append((5001, rows[-1][1].replace("v59999", "other")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_components(docs, count_links=True).collect()}
    sets = {}
    for i, t in rows:
        if i is not None and plain_sets(t):
            sets.setdefault(frozenset(plain_sets(t)), []).append(i)
    for a, ids in sets.items():
        links = sum(100 * len(a & b) >= 85 * len(a | b) for b in sets) - 1
        assert {got[i].n_links for i in ids} == {links}
    assert got[5001].component_id == 5000 and got[5000].n_shingles == 59_998


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(docs).count() == 0


def test_connected_components_of_paths_stars_and_rings(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    links = [p if rng.random() < 0.5 else p[::-1] for p in links] + [(5, 5), (300, 301), (301, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark, "t"), "c").collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)} | {i: 200 for i in range(200, 209)} | {300: 300, 301: 300}
    assert got == want
