"""The approximate index: recall against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import ann
from siltstone.operators.search import batched_topk
from siltstone.queries import queries
from siltstone.sources.tables import table


def frame(spark, x, kind="long"):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "point_id long, embedding array<float>").withColumn("point_id", F.col("point_id").cast(kind)).repartition(6)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 6000)] + 0.25 * rng.normal(size=(6000, 24))
    x[:2000] = x[0] + 0.02 * rng.normal(size=(2000, 24))  # a third of all in one list
    return frame(spark, x.astype(np.float32)).cache()


def test_few_lists_suffice_where_vectors_cluster(spark, clustered):
    books = ann.fit(clustered, lists=64, rounds=5)
    blocks = ann.indexed(clustered, books).cache()
    assert blocks.select(F.sum(F.size("ids"))).first()[0] == 6000
    assert blocks.select(F.max(F.size("ids"))).first()[0] <= ann.BLOCK
    probes, rescore, reached = ann.tuned(clustered, blocks, books, k=10, target=0.95, queries=60)
    assert probes <= 16 and reached >= 0.95
    asked = clustered.filter("point_id % 100 = 0").select(F.col("point_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = ann.approximate_topk(clustered, blocks, books, asked, 10, probes, rescore)
    assert ann.recall(found, batched_topk(clustered, asked, 10)) >= 0.9
    # the index knows vectors that are gone: they are not found
    some = clustered.filter("point_id >= 3000")
    assert ann.approximate_topk(some, blocks, books, asked, 10, probes).filter("point_id < 3000").isEmpty()


def test_all_lists_and_candidates_are_the_exact_search(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 10)).astype(np.float32)
    x[100:120] = x[100]
    odd = [("none", None), ("empty", []), ("wide", [1.0] * 11), ("zero", [0.0] * 10), ("nan", [float("nan")] * 10), ("hole", [None] * 10)]
    v = frame(spark, x, "string").unionByName(spark.createDataFrame(odd, "point_id string, embedding array<float>"))
    books = ann.fit(v, lists=12, parts=4, rounds=3)
    ann.save(ann.indexed(v, books), books, f"{tmp_path}/index")
    blocks, loaded = ann.load(spark, f"{tmp_path}/index")
    assert (loaded.centroids == books.centroids).all() and (loaded.words == books.words).all()
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 500, 25)], "query_id long, vector array<float>")
    found = ann.approximate_topk(v, blocks, loaded, asked, 7, probes=12, rescore=500)
    numbers = v.filter("point_id RLIKE '^[0-9]+$'").withColumn("point_id", F.col("point_id").cast("long"))
    exact = batched_topk(numbers, asked, 7)
    assert sorted((r.query_id, r.score) for r in found.collect()) == sorted((r.query_id, r.score) for r in exact.collect())


def test_all_lists_find_the_best_of_many_that_are_near(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(1, 16)), 3000, axis=0) + 1e-2 * rng.normal(size=(3000, 16))
    x[1000:1400] = x[1000]
    x[2000:] = rng.normal(size=(1000, 16))
    frame(spark, x.astype(np.float32)).withColumn("label", F.lit(0)).withColumnRenamed("point_id", "vec_id").write.parquet(f"{tmp_path}/embeddings.parquet")
    found, exact = (sorted(map(tuple, queries()[f"vector_topk_{name}"](spark, f"{tmp_path}").select("query_id", "rank", "point_id", "score").collect())) for name in ("all_lists", "batched"))
    assert len(found) == 300 and found == exact


def test_exact_search_by_lists_of_odd_vectors(spark):
    odd = [("none", None), ("empty", []), ("wide", [1.0] * 3), ("zero", [0.0] * 2), ("nan", [float("nan"), 1.0]), ("hole", [None, 1.0])]
    v = spark.createDataFrame([*odd, ("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("B", [3.0, 0.0])], "point_id string, embedding array<double>")
    books = ann.fit(v, lists=2)
    asked = spark.createDataFrame([("q", [4.0, 3.0]), *odd], "query_id string, vector array<double>")
    got = ann.exact_topk(v, ann.indexed(v, books, whole=True), books, asked, 3).collect()
    assert [(r.query_id, r.point_id, r.score, r["rank"]) for r in got] == [("q", "B", 0.8, 1), ("q", "a", 0.8, 2), ("q", "b", 0.8, 3)]
    more = ann.exact_topk(v, ann.indexed(v, books, whole=True), books, asked, 9)
    assert [(r.point_id, r.score) for r in more.orderBy("rank").collect()] == [("B", 0.8), ("a", 0.8), ("b", 0.8), ("c", 0.6)]


def test_recall_on_the_sample_table(spark):
    e = table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("point_id"), "embedding").cache()
    books = ann.fit(e)
    blocks = ann.indexed(e, books).cache()
    probes, rescore, _ = ann.tuned(e, blocks, books)
    asked = e.filter("point_id % 100 = 0").select(F.col("point_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert ann.recall(ann.approximate_topk(e, blocks, books, asked, 10, probes, rescore), batched_topk(e, asked, 10)) >= 0.9


def test_nothing_to_index(spark):
    assert ann.fit(spark.createDataFrame([], "point_id long, embedding array<float>")) is None
    assert ann.fit(spark.createDataFrame([(1, [0.0, 0.0])], "point_id long, embedding array<float>")) is None
    one = spark.createDataFrame([(1, [3.0, 4.0])], "point_id long, embedding array<float>")
    books = ann.fit(one)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, vector array<float>")
    got = ann.approximate_topk(one, ann.indexed(one, books), books, asked, 5, 1).collect()
    assert [(r.query_id, r.point_id, r.score, r["rank"]) for r in got] == [("q", 1, 0.6, 1)]
