"""Index runs: faults, resumption, change lists, targets, groups and moves."""

import os
import subprocess

import pytest

from siltstone.engine import Engine, Settings
from siltstone.operators import embedding, store
from siltstone.sources.json_files import write_local_group


class Picky(embedding.HashingProvider):
    """Fails on texts with a word, and counts what it is asked."""

    def __init__(self, bad="", width=8, name="hashing"):
        super().__init__(width, name)
        self.bad = bad

    def embed(self, texts):
        if self.bad and any(self.bad in t for t in texts):
            raise RuntimeError("cannot embed")
        return super().embed(texts)


def write(root, files):
    for name, text in files.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def files_of(engine, root):
    return {os.path.relpath(r.file_path, root) for r in engine.vectors.read(engine._names(str(root))[1]).select("file_path").distinct().collect()}


@pytest.fixture
def ws(tmp_path):
    root = tmp_path / "ws"
    write(root, {"docs/x.md": "# One\ntext\n", "docs/y.md": "# Two\nbroken words\n", "src/latin.md": b"# caf\xe9\nold text\n", "bin/no.md": "# no\n", "src/[odd] {name}.md": "# odd\n"})
    return root


def test_failed_chunks_are_done_again(spark, ws, tmp_path):
    e = Engine(spark, f"{tmp_path}/store", Picky("broken"))
    first = e.index_workspace(str(ws))
    assert first.warnings == ["cannot embed"] and first.files_changed == 4
    assert files_of(e, ws) == {"docs/x.md", "src/latin.md", "src/[odd] {name}.md"}
    e.provider = Picky()
    second = e.index_workspace(str(ws))
    assert (second.files_changed, second.chunks_indexed, second.warnings) == (1, 1, [])
    assert "docs/y.md" in files_of(e, ws)
    text = e.vectors.read(first.collection_name).filter("content LIKE '%old text%'").first().content
    assert "caf�" in text  # bytes that are no UTF-8


def test_another_model_needs_force(spark, ws, tmp_path):
    e = Engine(spark, f"{tmp_path}/store", Picky())
    e.index_workspace(str(ws))
    e.provider = Picky(name="other", width=4)
    with pytest.raises(ValueError, match="force"):
        e.index_workspace(str(ws))
    with pytest.raises(ValueError, match="as a whole"):
        e.index_workspace(str(ws), force=True, profile="docs")
    done = e.index_workspace(str(ws), force=True)
    assert done.full_reindex and done.files_changed == 4
    assert e.vectors.width(done.collection_name) == 4
    assert e.vectors.head(done.collection_name)["embedding_model"] == "other"
    # a catalog of installed models decides on the name
    models = embedding.ModelCatalog([{"name": "other:latest"}])
    assert Engine(spark, f"{tmp_path}/s", Picky(name="none"), Settings(fallback_model="other"), models)._model()[0] == "other:latest"
    with pytest.raises(LookupError):
        Engine(spark, f"{tmp_path}/s", Picky(name="none"), models=models).index_workspace(str(ws))


@pytest.mark.parametrize("step", ["promote", "_register"])
def test_a_run_that_stops_between_two_writes(spark, ws, tmp_path, monkeypatch, step):
    e = Engine(spark, f"{tmp_path}/store", Picky())
    name = e.index_workspace(str(ws)).collection_name
    before = sorted(r.point_id for r in e.vectors.read(name).collect())
    (ws / "docs/x.md").write_text("# One\nother text\n")
    os.remove(ws / "docs/y.md")
    owner = store.VectorStore if step in ("build", "promote") else Engine
    real = getattr(owner, step)

    def stop(self, *a, **k):
        if step in ("build", "promote") and a[0] != name:
            return real(self, *a, **k)
        raise OSError("stopped")

    monkeypatch.setattr(owner, step, stop)
    with pytest.raises(OSError, match="stopped"):
        e.index_workspace(str(ws))
    monkeypatch.setattr(owner, step, real)
    if step in ("build", "promote"):  # points and state are the old ones, both
        assert sorted(r.point_id for r in e.vectors.read(name).collect()) == before
        assert e.state(name).count() == 4
    again = e.index_workspace(str(ws))
    assert again.files_changed == (1 if step in ("build", "promote") else 0)
    assert files_of(e, ws) == {"docs/x.md", "src/latin.md", "src/[odd] {name}.md"}
    assert e.registry().count() == 1


def test_a_stopped_run_is_taken_up(spark, ws, tmp_path, monkeypatch):
    steps = []
    e = Engine(spark, f"{tmp_path}/store", Picky(), Settings(checkpoint_files=1, progress=steps.append))
    monkeypatch.setattr(store.VectorStore, "build", lambda *a, **k: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        e.index_workspace(str(ws))
    monkeypatch.undo()
    assert [s.current for s in steps if s.stage == "embed"][-1] == 4
    (ws / "docs/y.md").write_text("# Two\nchanged since\n")
    steps.clear()
    done = e.index_workspace(str(ws))
    assert [(s.current, s.total) for s in steps if s.stage == "embed"] == [(1, 1)]  # only what changed since
    assert done.chunks_indexed == 4 and len(files_of(e, ws)) == 4
    assert [s.stage for s in steps] == ["scan", "embed", "write", "done"]
    assert not os.path.exists(f"{tmp_path}/store/staging/{done.collection_name}")


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@example.org", *args], check=True, capture_output=True)


def test_change_lists_of_the_repository_are_used(spark, ws, tmp_path):
    steps = []
    git(ws, "init", "-q")
    git(ws, "add", "-A")
    git(ws, "commit", "-qm", "one")
    e = Engine(spark, f"{tmp_path}/store", Picky(), Settings(progress=steps.append))
    (ws / "docs/x.md").write_text("# One\nnot committed\n")
    e.index_workspace(str(ws))
    assert steps[0].message == "all files"
    git(ws, "checkout", "docs/x.md")  # what was changed then is as committed again
    os.remove(ws / "docs/y.md")
    write(ws, {"docs/new.md": "# New\n", "bin/more.md": "# no\n"})
    steps.clear()
    done = e.index_workspace(str(ws))
    assert "change list" in steps[0].message and done.files_scanned == 2
    assert (done.files_changed, done.files_deleted) == (2, 1)
    assert files_of(e, ws) == {"docs/x.md", "docs/new.md", "src/latin.md", "src/[odd] {name}.md"}
    assert e.state(done.collection_name).count() == 4
    assert e.index_workspace(str(ws), excludes=["src"]).files_deleted == 2  # other rules: all files are compared
    assert files_of(e, ws) == {"docs/x.md", "docs/new.md"}


def test_change_lists_name_files_of_new_folders(spark, ws, tmp_path):
    git(ws, "init", "-q")
    git(ws, "add", "-A")
    git(ws, "commit", "-qm", "one")
    e = Engine(spark, f"{tmp_path}/store", Picky())
    e.index_workspace(str(ws))
    write(ws, {"new/deep/a.md": "# A\n", "new/b.md": "# B\n"})
    assert e.index_workspace(str(ws)).files_changed == 2
    assert {"new/deep/a.md", "new/b.md"} <= files_of(e, ws)


def test_change_lists_keep_to_the_workspace(spark, tmp_path):
    top = tmp_path / "top"
    write(top, {"a/one.md": "# One\n", "b/two.md": "# Two\n", "a/three.md": "# Three\n", "ab/x.md": "# X\n"})
    git(top, "init", "-q")
    git(top, "add", "-A")
    git(top, "commit", "-qm", "one")
    e = Engine(spark, f"{tmp_path}/store", Picky())
    e.index_workspace(str(top / "a"))
    write(top, {"b/two.md": "# Two again\n", "b/new.md": "# New\n", "a/one.md": "# One again\n", "ab/x.md": "# X again\n"})
    git(top, "mv", "a/three.md", "b/three.md")
    git(top, "add", "-A")
    git(top, "commit", "-qm", "two")
    done = e.index_workspace(str(top / "a"))
    assert (done.files_changed, done.files_deleted) == (1, 1)
    assert files_of(e, top / "a") == {"one.md"}
    assert [os.path.basename(r.file_path) for r in e.state(done.collection_name).collect()] == ["one.md"]


def test_several_targets_and_names(spark, tmp_path):
    ws = tmp_path / "ws"
    write(ws, {
        "all.sln": 'Project("{X}") = "A", "a\\A.csproj", "{Y}"', "a/A.csproj": "<Project/>", "a/x.cs": "class X { void M() { } }",
        "docs/one.md": "# One\n", "docs/two.md": "# Two\n", "notes/n.md": "# N\n", "other/o.md": "# O\n",
    })
    e = Engine(spark, f"{tmp_path}/store", Picky())
    done = e.index_workspace(str(ws), [f"{ws}/docs", f"{ws}/notes/n.md"])
    assert done.files_scanned == 3 and files_of(e, ws) == {"docs/one.md", "docs/two.md", "notes/n.md"}
    os.remove(ws / "docs/two.md")
    write(ws, {"notes/n.md": "# N again\n", "other/o.md": "# O again\n"})
    done = e.index_workspace("WS", [f"{ws}/all.sln", f"{ws}/docs"])  # by its name
    assert (done.files_changed, done.files_deleted) == (3, 1)
    assert files_of(e, ws) == {"docs/one.md", "notes/n.md", "all.sln", "a/A.csproj", "a/x.cs"}
    assert e.registry().first().indexed_targets == [f"{ws}/docs", f"{ws}/notes/n.md", f"{ws}/all.sln"]
    with pytest.raises(FileNotFoundError):
        e.index_workspace("nobody")
    with pytest.raises(PermissionError):
        Engine(spark, f"{tmp_path}/store", Picky(), Settings(allowed_roots=(str(ws),))).index_workspace(str(ws), [f"{ws}/docs", f"{tmp_path}/x"])


def test_beginnings_are_enough_to_classify(spark, tmp_path):
    ws = tmp_path / "ws"
    write(ws, {"docs/long.md": "# Long\n" + "word " * 6_000 + "\n## Last\nthe end\n", "bin/no.md": "# no\n"})
    e = Engine(spark, f"{tmp_path}/store", Picky(), Settings(fingerprint_content=False))
    name = e.index_workspace(str(ws)).collection_name
    assert e.vectors.read(name).filter("content LIKE '%the end%'").count() == 1
    assert e.index_workspace(str(ws)).files_changed == 0


def test_groups_grow(spark, tmp_path):
    from siltstone.cli import main

    store_dir = f"{tmp_path}/store"
    assert main(["--store", store_dir, "group", "create", "Both", "--root", "/a"]) == 0
    assert main(["--store", store_dir, "group", "add", "both", "--root", "/A", "--root", "/b", "-x", "bin"]) == 0
    row = Engine(spark, store_dir).groups().first()
    assert (row.name, row.roots, row.exclude_directories) == ("Both", ["/a", "/b"], ["bin"])
    assert main(["--store", store_dir, "workspace", "migrate", "/none", "--to", "/x"]) == 1


def test_searches_by_an_index(spark, tmp_path):
    ws = tmp_path / "ws"
    write(ws, {f"d{k % 5}/f{k}.md": f"# Title {k}\nwords number {k} of topic {k % 7}\n" for k in range(120)})
    e = Engine(spark, f"{tmp_path}/store", Picky(width=16))
    done = e.index_workspace(str(ws))
    made = e.build_vector_index(str(ws), lists=6, k=10)
    assert made["recall"] >= 0.95 and made["lists"] == 6
    ask = lambda approximate: [(r.file_path, r.score) for r in e.search_code("topic 3 words", 5, approximate=approximate, workspace_root=str(ws)).orderBy("rank").collect()]
    exact = ask(False)
    assert len({p for p, _ in ask(True)} & {p for p, _ in exact}) >= 4
    # what comes later is found beside the index, what goes is not
    write(ws, {"new.md": "# topic 3 words\ntopic 3 words\n"})
    os.remove(exact[0][0])
    e.index_workspace(str(ws))
    assert e.vectors.head(done.collection_name)["index"]["folder"] == made["folder"]
    again = [p for p, _ in ask(True)]
    assert str(ws / "new.md") in again and exact[0][0] not in again
    # filters that leave too few: everywhere
    assert e.search_code("topic", 5, content_type="code", approximate=True, workspace_root=str(ws)).count() == 0
    e.index_workspace(str(ws), force=True)
    assert e.vectors.head(done.collection_name)["index"] is None


def test_a_small_change_writes_little(spark, tmp_path):
    ws = tmp_path / "ws"
    write(ws, {f"d{k % 5}/f{k}.md": "".join(f"# Title {k} {j}\nsome words {j * k}\n" for j in range(40)) for k in range(60)})
    e = Engine(spark, f"{tmp_path}/store", Picky())
    name = e.index_workspace(str(ws)).collection_name
    before = e.vectors.bytes_written(name)
    write(ws, {"d1/f1.md": "# Other\ntext\n"})
    done = e.index_workspace(str(ws))
    assert (done.files_changed, done.chunks_indexed) == (1, 1)
    assert e.vectors.bytes_written(name) - before < before / 5
    assert e.state(name).count() == 60 and e.vectors.read(name).filter("file_path LIKE '%/d1/f1.md'").count() == 1


def test_solution_targets_and_aliases(spark, tmp_path):
    ws = tmp_path / "ws"
    project = "<Project><ItemGroup>{}</ItemGroup></Project>"
    write(ws, {
        "all.sln": 'Project("{X}") = "A", "a\\A.csproj", "{Y}"', "a/A.csproj": project.format('<ProjectReference Include="..\\b\\B.csproj" />'),
        "b/B.csproj": project.format(""), "a/x.cs": "class X { void M() { } }", "b/y.cs": "class Y { void M() { } }", "c/z.cs": "class Z { void M() { } }",
        "Directory.Build.props": "<Project/>", ".git/HEAD": "ref: x", "a/deep/d.cs": "class D { void M() { } }",
    })
    e = Engine(spark, f"{tmp_path}/store", Picky())
    assert e.workspace_of(f"{ws}/a/deep") == str(ws)
    done = e.index_workspace(str(ws), target=f"{ws}/all.sln")
    assert files_of(e, ws) == {"all.sln", "a/A.csproj", "b/B.csproj", "a/x.cs", "b/y.cs", "a/deep/d.cs", "Directory.Build.props"}
    os.remove(ws / "b/y.cs")
    assert e.index_workspace(str(ws), target=f"{ws}/all.sln").files_deleted == 1
    row = e.registry().first()
    assert row.aliases[:3] == ["ws", "all.sln", "all"] and len(row.indexed_targets) == 1
    assert e.search_code("class", workspace_root="ALL").count() > 0
    assert done.chunks_indexed > 5
    with pytest.raises(FileNotFoundError):
        e.index_workspace(f"{ws}/none")


def test_local_groups_and_moving_a_group(spark, tmp_path):
    for k in "ab":
        write(tmp_path / k, {"x.md": f"# Title {k}\nsome words\n"})
    groups = f"{tmp_path}/groups.json"
    write_local_group(groups, "Pair", [f"{tmp_path}/a", f"{tmp_path}/b"])
    e = Engine(spark, f"{tmp_path}/store", Picky(), Settings(local_groups=groups, groups=(("fixed", (f"{tmp_path}/a",)),)))
    assert {(r.name, r.source) for r in e.groups().collect()} == {("Pair", "local"), ("fixed", "configured")}
    assert [r.files_changed for r in e.index_group("pair")] == [1, 1]
    assert e.search_code("words", workspace_group="PAIR").count() == 2
    assert {tuple(r.groups) for r in e.registry().collect()} == {("Pair",), ("Pair", "fixed")}
    with pytest.raises(ValueError):
        e.save_group("FIXED", [f"{tmp_path}/b"], local=True)
    e.save_group("more", [f"{tmp_path}/b"], local=True)
    e.delete_group("More")
    e.export_group("pair", f"{tmp_path}/out")
    other = Engine(spark, f"{tmp_path}/other", Picky())
    assert len(other.import_workspace(f"{tmp_path}/out", {str(tmp_path): "/moved"})) == 2
    assert {r.workspace_root for r in other.search_code("words", workspace_group="pair").select("file_path").collect() and other.registry().collect()} == {"/moved/a", "/moved/b"}
    assert sorted(other.groups().first().roots) == ["/moved/a", "/moved/b"]
    with pytest.raises(LookupError):
        e.export_group("none", f"{tmp_path}/out2")


def test_pointers_are_never_missing(spark, tmp_path):
    s = store.VectorStore(spark, f"{tmp_path}/s")
    points = spark.createDataFrame([("a", [1.0, 2.0])], "point_id string, embedding array<float>")
    for k in range(1, 5):
        assert s.build("t", points.limit(k)) == k
        s.promote("t", k)
    assert s.active("t") == 4 and s.versions("t") == [3, 4]
    s.promote("t", 3)  # back to the version before
    assert s.active("t") == 3 and s.read("t").count() == 1 and s.head("t") is None
    with pytest.raises(Exception, match="vector of width"):
        s.build("t", spark.createDataFrame([("b", [1.0])], points.schema))
