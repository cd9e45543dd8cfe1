"""Prefix tries against a dictionary of prefixes."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from siltstone.llm import prefix_trie
from siltstone.llm.louds import Louds, level_order
from siltstone.llm.prefix_trie import PrefixTrie, conversation_nodes


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            label = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, label, role, text))
    turns = {c: [x[3:] for x in sorted(some)] for c, some in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in turns:
        h = crc32(str(c).encode()) % 9
        made = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(made) + 1):
            members[made[:d]].add(c)
        ends[made].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, some in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(some) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items()), key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for c in range(-10, n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 2, 3, 8, 9, 12])):
            role = rng.choice(["user", "assistant", None])
            text = "hello" if t == 0 and rng.random() < 0.6 else rng.choice(["", "é", "same", None, f"t{rng.randrange(40)}"])
            rows.append((c, t if rng.random() < 0.95 else rng.choice([None, 3]), role, text))
        if rng.random() < 0.3:
            rows.append(rows[-1])
    rows += [(1000 + k, t, "user", text) for k in range(100) for t, text in enumerate(("the same", "again"))]
    rows += [(2000, t, "user", f"very long {t}") for t in range(700)] + [(None, 1, "user", "nobody"), (2003, 1, "a", "x" * 100_000)]
    return rows


@pytest.mark.parametrize(("seed", "heavy", "band", "nodes"), [(1, 4, 256, 100_000), (2, 3, 200, 50), (3, 10_000, 300, 40)])
def test_prefixes(spark, monkeypatch, seed, heavy, band, nodes):
    monkeypatch.setattr(prefix_trie, "LEAST_HEAVY", heavy)
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", nodes)
    rows = corpus(seed)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_nodes(table.selectExpr("*", "1 AS family", "2 AS label", "3 AS bytes", "4 AS depth").repartition(7)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_stored_tries_are_whole(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_HEAVY", 5)
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", 60)
    table = spark.createDataFrame(corpus(4), "conv_id long, turn long, role string, text string")
    nodes, tries = PrefixTrie(table).nodes()
    stored = tries.collect()
    assert len(stored) > 3
    keys = [bytes(t.labels[16 * i : 16 * i + 16]) for t in stored for i in range(t.n)]
    assert sorted(keys) == sorted(bytes(r.key) for r in nodes.collect())
    assert all(8 * len(t.bits) < 2 * t.n + 9 for t in stored)


def test_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_nodes(spark.createDataFrame([], schema)).collect() == []
    assert conversation_nodes(spark.createDataFrame([(None, 1, "a", "b")], schema)).collect() == []
    one = conversation_nodes(spark.createDataFrame([(7, None, None, None)], schema)).collect()
    assert sorted((tuple(r) for r in one), key=repr) == plain([(7, None, None, None)])


@pytest.mark.parametrize("seed", range(5))
def test_level_order_and_bits(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 200))
    parents = np.array([int(rng.integers(-1, i)) if i else -1 for i in range(n)])
    names = rng.permutation(n)
    mixed = np.full(n, -1)
    mixed[names] = np.where(parents < 0, -1, names[parents])
    order = level_order(mixed)
    at = np.empty(n, dtype=int)
    at[order] = np.arange(n)
    above = np.where(mixed[order] < 0, -1, at[mixed[order]])
    assert (np.diff(above) >= 0).all()
    trie = Louds.unpacked(Louds.of_parents(above).packed(), n)
    assert len(trie) == n and (trie.parents() == above).all()
    assert [list(trie.children(i)) for i in range(-1, n)] == [np.flatnonzero(above == i).tolist() for i in range(-1, n)]
    assert (trie.degrees() == [len(trie.children(i)) for i in range(n)]).all()
    levels = trie.levels()
    assert [a for a, _ in levels[1:]] == [b for _, b in levels[:-1]] and levels[-1][1] == n
    assert all((above[a:b] >= 0).all() == bool(a) for a, b in levels)


def test_a_cycle_is_no_forest():
    with pytest.raises(ValueError, match="forest"):
        level_order(np.array([1, 0, -1]))
