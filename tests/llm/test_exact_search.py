"""Exact search against all pairs."""

import math
import random

import numpy as np
import pytest

from siltstone.llm import exact_search
from siltstone.llm.exact_search import Best, Page, Queries, _paged, nearest


def plain(rows, k, every=50, scale=256):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [max(-(1 << 62), min(1 << 62, math.floor(scale * float(x)))) for x in v]))
    out = []
    for a, (i, v) in enumerate(usable):
        if i % every:
            continue
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, w)))), j) for b, (j, w) in enumerate(usable) if b != a and len(w) == len(v)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(1000 + i, same) for i in range(400)]  # a vector that many rows share, queries among them
    rows += [(2000 + i, [x + 0.001 * float(rng.normal()) for x in same]) for i in range(300)]  # near copies
    rows += [(3000, None), (3050, [None] * 8), (3100, [math.nan] * 8), (3150, [math.inf] + [0.0] * 7), (None, same)]
    rows += [(4000, [0.0] * 8), (4050, [0.0] * 8), (0, same), (50, rows[50][1]), (50, rows[50][1])]
    rows += [(5000, [1.0, 2.0]), (5001, [2.0, 1.0]), (5050, [3.0]), (6000, []), (6050, [])]
    return rows


@pytest.mark.parametrize(("seed", "k", "scale"), [(1, 5, 256), (2, 1, 3), (3, 5, 2**40)])
def test_all_pairs(spark, monkeypatch, seed, k, scale):
    monkeypatch.setattr(exact_search, "PAGE", 64)
    monkeypatch.setattr(exact_search, "TILE", 16)
    monkeypatch.setattr(exact_search, "QUERIES", 20)
    monkeypatch.setattr(exact_search, "PAIRS", 100)
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS width", "2 AS v", "3 AS score", "4 AS query").repartition(5)
    got = nearest(table, k=k, scale=scale)
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, k, scale=scale)


def test_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema)).collect() == []
    assert nearest(spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    assert nearest(spark.createDataFrame([(7, [1.0]), (8, [1.0])], schema)).collect() == []


def test_few_exact_vectors_are_read():
    """Cells alone decide about nearly all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(size=(8192, 64))
    whole = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<i2")
    batch = pa.RecordBatch.from_arrays([pa.array([64] * len(whole), pa.int32()), pa.array([v.tobytes() for v in whole]), pa.array([[i] for i in range(len(whole))])], names=["width", "v", "ids"])
    asked = Queries(list(range(100)), [v.tobytes() for v in whole[:100]], 64)
    best, reads = Best(100, 6), 0
    for page in _paged(iter([batch])):
        reads += Page(*(c[0].as_py() for c in page.columns)).search(best, asked, np.full(100, -(1 << 62)))
    scores = whole[:100].astype(np.int64) @ whole.T.astype(np.int64)
    assert (np.sort(scores, axis=1)[:, ::-1][:, :6] == best.scores).all()
    assert reads < 0.03 * 100 * len(whole)
