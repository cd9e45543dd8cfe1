"""Trees as a data source: what is listed, what is read, and what comes out."""

import os

import pytest
from pyspark.sql import functions as F

from siltstone.operators import scan
from siltstone.sources.tree_source import Walk, can_list


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "ws"
    for k in range(30):
        for name in (f"src/p{k % 6}/f{k}.cs", f"docs/d{k}.md", f"bin/b{k}.dll", f"src/p{k % 6}/node_modules/m{k}.js", f"src/p{k % 6}/keep/bin{k}.txt"):
            os.makedirs((top / name).parent, exist_ok=True)
            (top / name).write_text("é" * 20_000 if name.endswith(".md") else f"text {k}")
    (top / "top.txt").write_bytes(b"caf\xe9")
    (top / "odd [x] {y}%20.txt").write_text("odd")
    os.symlink(top / "docs", top / "link")
    return top


EXCLUDED = ["bin", "NODE_MODULES", "src/p3/keep"]


def wanted(root, below=""):
    out = set()
    for here, directories, files in os.walk(root):
        directories[:] = [d for d in directories if d not in ("bin", "node_modules") and os.path.relpath(f"{here}/{d}", root) != "src/p3/keep"]
        out |= {os.path.join(here, f) for f in files if os.path.join(here, f).startswith(f"{root}/{below}")}
    return out


@pytest.mark.parametrize("shares", [1, 3, 8, 1000])
def test_excluded_directories_are_never_listed(root, shares):
    walk = Walk(str(root), EXCLUDED)
    parts = walk.shares(shares)
    assert len(parts) <= shares
    found = [f for part in parts for f, _, _ in walk.all_of(part)]
    assert sorted(found) == sorted(wanted(root))  # each once
    listed = walk.files.listed
    assert len(listed) == len(set(listed)) and not any(x.endswith(("/bin", "/node_modules", "p3/keep", "/link")) for x in listed)


def test_targets_are_the_only_way_in(root):
    walk = Walk(str(root), EXCLUDED, [f"{root}/SRC/p2", f"{root}/docs/d4.md"])
    found = {f for part in walk.shares(4) for f, _, _ in walk.all_of(part)}
    assert found == wanted(root, "src/p2/") | {f"{root}/docs/d4.md"}
    assert set(walk.files.listed) == {str(root), f"{root}/src", f"{root}/src/p2", f"{root}/src/p2/keep", f"{root}/docs"}


def test_probes_read_the_beginning_only(root):
    walk = Walk(str(root))
    assert walk.content(f"{root}/docs/d1.md", 4096) == "é" * 4096
    assert walk.files.bytes_read == 4 * 4096
    assert walk.content(f"{root}/docs/d1.md", 0) is None and walk.files.bytes_read == 4 * 4096
    assert walk.content(f"{root}/top.txt", None) == "caf�"


def test_trees_as_frames(spark, root):
    rows = scan.tree(spark, str(root), excluded_directories=EXCLUDED).collect()
    assert {r.file_path for r in rows} == wanted(root) and len(rows) == len(wanted(root))
    by_name = {os.path.basename(r.file_path): r for r in rows}
    assert by_name["top.txt"].content == "caf�" and by_name["top.txt"].size == 4
    assert by_name["d3.md"].content == "é" * 20_000 and by_name["odd [x] {y}%20.txt"].content == "odd"
    assert abs(by_name["d3.md"].last_write_time_utc.timestamp() - os.path.getmtime(root / "docs/d3.md")) < 1
    heads = scan.tree(spark, f"file://{root}", excluded_directories=EXCLUDED, characters=10)
    assert heads.filter(F.length("content") > 10).isEmpty() and heads.count() == len(rows)
    whole = scan.read_files(spark, str(root), [str(root / "docs/d3.md")]).first()
    assert (whole.file_path, whole.content, whole.size) == tuple(by_name["d3.md"][c] for c in ("file_path", "content", "size"))
    assert scan.tree(spark, str(root / "none")).collect() == []


def test_what_can_be_listed():
    assert can_list("/a") and can_list("file:///a") and not can_list("viewfs://store/in")
