"""Registered queries against their SQL on the smallest tables, and the entry module without the optional parts."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import siltstone.queries as engine

TABLES = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, con, name):
    df = engine.queries()[name](spark, TABLES)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    if name not in engine.oracle_sql():
        assert rows
        return
    rel = con.sql(engine.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert rows == want


def test_entry_stands_without_the_optional_parts(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.split() == [str(len(engine.queries())), "False"]


def test_nothing_else_imports_the_optional_parts():
    for f in [*REPO.glob("siltstone/**/*.py"), *REPO.glob("tests/*.py"), REPO / "bench.py"]:
        if "llm" not in f.relative_to(REPO).parts and f.exists() and f != Path(__file__):
            text = f.read_text()
            assert "siltstone.llm" not in text and "corpus_pipeline" not in text, f
