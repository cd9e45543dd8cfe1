"""Stores of segments: what a change writes, what readers see, and what is left after it."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.operators import segments, store

SHAPE = "point_id string, embedding array<float>, workspace_id string, file_path string, content string"


def points(spark, rows):
    return spark.createDataFrame([(i, [float(v), 1.0], w, p, f"text {v} " * 20) for i, v, w, p in rows], SHAPE)


def seen(df):
    return sorted((r.point_id, r.embedding[0], r.file_path) for r in df.collect())


@pytest.fixture
def base(spark, tmp_path):
    s = store.VectorStore(spark, f"{tmp_path}/s")
    rows = [(f"p{i}", i, "w", f"/ws/{'ab'[i % 2]}/f{i // 4}.cs") for i in range(20_000)]
    state = spark.createDataFrame([(f"/ws/f{k}", f"print{k}", k) for k in range(5000)], "file_path string, fingerprint string, chunk_count int")
    s.promote("t", s.build("t", points(spark, rows), state=state, head={"model": "m"}))
    return s, rows, state


def test_a_small_change_writes_little(spark, base):
    s, rows, state = base
    first = s.bytes_written("t")
    new = state.withColumn("fingerprint", F.when(F.col("file_path") == "/ws/f7", "other").otherwise(F.col("fingerprint"))).filter("file_path <> '/ws/f9'")
    gone = points(spark, [("x", 0, "w", "/WS/A/f10.cs")]).select("file_path")
    version = s.change("t", points(spark, [("p40", -1, "w", "/ws/a/f10.cs"), ("p3", -3, "w", "/ws/b/f0.cs")]), [lambda r: store.of_files(r, "w", gone)], state=new, head={"model": "n"})
    assert s.bytes_written("t") - first < first / 10
    assert seen(s.read("t")) == seen(points(spark, rows)) and s.head("t") == {"model": "m"}  # not active yet
    s.promote("t", version)
    keep = [(i, v, w, p) for i, v, w, p in rows if p != "/ws/a/f10.cs" and i != "p3"]
    assert seen(s.read("t")) == seen(points(spark, [*keep, ("p40", -1, "w", "/ws/a/f10.cs"), ("p3", -3, "w", "/ws/b/f0.cs")]))
    assert sorted(map(tuple, s.read("t", "state").collect())) == sorted(map(tuple, new.collect())) and s.head("t") == {"model": "n"}
    whole = s.bytes_written("t")
    s.compact("t")
    s.compact("t")  # the version before the first goes, and its segments with it
    assert s.bytes_written("t") < whole * 2.1
    assert len(s.read("t").collect()) == len(keep) + 2


def test_random_changes_against_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MOST_FOLDERS", 6)
    rng = random.Random(3)
    s = store.VectorStore(spark, f"{tmp_path}/s")
    want = {f"p{i}": (f"p{i}", i, "w", f"/ws/d{i % 3}/f{i % 7}.cs") for i in range(60)}
    s.upsert("t", points(spark, want.values()))
    for step in range(8):
        some = [(f"p{rng.randrange(90)}", 100 * step + k, "w", f"/ws/d{rng.randrange(3)}/f{rng.randrange(7)}.cs") for k in range(5)]
        match rng.randrange(3):
            case 0:
                s.delete_directories("t", "w", [f"/ws/D{step % 3}/"])
                want = {k: v for k, v in want.items() if not v[3].startswith(f"/ws/d{step % 3}/")}
            case 1:
                s.delete_files("t", "w", points(spark, some).select("file_path"))
                want = {k: v for k, v in want.items() if v[3] not in {r[3] for r in some}}
            case _:
                once = {r[0]: r for r in some}
                s.upsert("t", points(spark, once.values()))
                want |= once
        assert seen(s.read("t")) == seen(points(spark, want.values()))
    assert len(s.versions("t")) == 2


def test_bitmaps_of_large_files(spark, tmp_path):
    s = segments.Segments(spark, f"{tmp_path}/s", lambda: F.col("id"))
    first = segments.Manifest([s.append(spark.range(100_000).coalesce(1))])
    wanted = "id % 7 = 0 OR id BETWEEN 32760 AND 32780 OR id = 99999"
    second = s.changed(first, None, s.live(first).filter(wanted))
    third = s.changed(second, spark.range(5), s.live(second).filter("id % 5 = 0"))
    assert s.read(second).exceptAll(spark.range(100_000).filter(f"NOT ({wanted})")).isEmpty()
    assert s.read(second).count() == spark.range(100_000).filter(f"NOT ({wanted})").count()
    left = spark.range(100_000).filter(f"NOT ({wanted} OR id % 5 = 0)").union(spark.range(5))
    assert sorted(r.id for r in s.read(third).collect()) == sorted(r.id for r in left.collect())
    assert s.read(first).count() == 100_000  # older states stay


def test_a_directory_is_a_range_of_the_scan(spark, base, capsys):
    s, rows, _ = base
    below = s.read_below("t", "/WS/a/")
    assert below.count() == sum(p.startswith("/ws/a/") for _, _, _, p in rows)
    below.explain("formatted")
    said = capsys.readouterr().out
    assert "GreaterThanOrEqual(_key,/ws/a/)" in said and "LessThan(_key,/ws/a0)" in said


@pytest.mark.parametrize("root", ["/ws", "/ws/", "/WS/Sub", "c:\\Code", "/ws/a b"])
def test_subtree_says_what_is_under_says(spark, root):
    names = ["/ws", "/ws/x", "/ws0", "/ws-/x", "/ws/Sub", "/ws/sub/x/y", "/ws/sub.x", "/WS/SUB/é", "C:\\code\\x", "c:/code", "c:/codex", "/ws/a b/c", "", "/"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    differ = df.filter(P.subtree(P.sort_key(F.col("p")), root) != P.is_under(F.col("p"), F.lit(root)))
    assert differ.collect() == []
