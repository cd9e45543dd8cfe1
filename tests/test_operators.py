"""Operators on small tables with known answers, and the engine end to end."""

import os
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siltstone.cli import delimited, main, parser, path_map
from siltstone.engine import Engine
from siltstone.functions import classify as C
from siltstone.operators import blocks, catalog, chunking, embedding, evaluation, scanners, search, solution, store, transfer
from siltstone.sources import changes
from siltstone.streaming import triggers

HIT = "query_id int, point_id int, file_path string, symbol_name string, symbol_kind string, start_line int, end_line int, score double, preview string, content_type string, index_profile string, language string"


def hits(spark, rows):
    return spark.createDataFrame([(0, k, f, s, "M", a, b, score, f"p{k}", "code", "code", "csharp") for k, (f, s, a, b, score) in enumerate(rows)], HIT)


def test_packing_merges_touching_ranges_and_stops_at_the_limit(spark):
    rows = [("/a", "S", 1, 5, 0.9), ("/A", "s", 5, 8, 0.8), ("/a", "T", 20, 25, 0.7), ("/a", "S", 9, 9, 0.6)]
    got = [(r.rank, r.symbol_name, r.start_line, r.end_line, r.preview) for r in search.packed(hits(spark, rows), 2).orderBy("rank").collect()]
    assert got == [(1, "S", 1, 8, "p0\np1"), (2, "T", 20, 25, "p2")]
    # a hit apart becomes the one to merge with
    rows = [("/a", "S", 1, 5, 0.9), ("/a", "S", 50, 55, 0.8), ("/a", "S", 6, 6, 0.7), ("/a", "S", 56, 60, 0.6)]
    got = [(r.start_line, r.end_line) for r in search.packed(hits(spark, rows), 9).orderBy("rank").collect()]
    assert got == [(1, 5), (50, 60), (6, 6)] or got == [(1, 5), (50, 55), (6, 6), (56, 60)]


def test_evaluation_numbers(spark):
    e = "query_id int, expected array<struct<file:string,fileContains:string,symbol:string,symbolContains:string,contentContains:string,contentType:string,indexProfile:string>>"
    want = spark.createDataFrame([(1, [("B.cs", None, "", None, None, None, None)]), (2, [(None, None, "none", None, None, None, None)])], e)
    results = spark.createDataFrame([(q, r, f"/x/{n}.cs", n, "text", "code", "code") for q in (1, 2) for r, n in ((1, "a"), (2, "b"))], "query_id int, rank int, file_path string, symbol_name string, preview string, content_type string, index_profile string")
    row = evaluation.metrics(evaluation.best_ranks(want, results)).first()
    assert (row.pass_rate, row.hit_rate_at_1, row.hit_rate_at_5, row.mrr, row.average_best_rank) == (0.5, 0.0, 0.5, 0.25, 2.0)
    none = spark.createDataFrame([(1, []), (3, [])], e)
    assert {r.query_id: r.best_rank for r in evaluation.best_ranks(none, results).collect()} == {1: 1, 3: None}


def test_suite_settings():
    suite = evaluation.load_suite('{"limit": 3, // the suite\n "hybrid": false, "queries": [{"query": "a // b", "limit": 7,}, {"query": "c"}, /* x */ ]}')
    assert [(q["query"], q["limit"], q["hybrid"]) for q in evaluation.query_settings(suite, {"limit": 5})] == [("a // b", 7, False), ("c", 5, False)]
    assert evaluation.query_settings({"queries": [{"query": "q"}]})[0]["limit"] == 10
    assert (evaluation.exit_code(2, 2), evaluation.exit_code(1, 2)) == (0, 2)


def test_change_lists():
    assert changes.parse_status(" M a.cs\0R  new.cs\0old.cs\0?? x y.cs\0 D gone.cs\0") == [("a.cs", "change"), ("old.cs", "delete"), ("new.cs", "change"), ("x y.cs", "change"), ("gone.cs", "delete")]
    assert changes.parse_name_status("M\0a\0R100\0b\0c\0D\0d\0A\0e\0") == [("a", "change"), ("b", "delete"), ("c", "change"), ("d", "delete"), ("e", "change")]
    assert changes.parse_tfs_history(["Changeset: 5", "  edit $/P/a.cs;C5", "  delete, source rename $/P/b.cs"]) == [("$/P/a.cs", "change"), ("$/P/b.cs", "delete")]
    folds = changes.parse_workfold([" $/P: C:\\w\\p", " $/P/sub: /home/sub"])
    assert changes.server_to_local("$/p/sub/x", folds) == "/home/sub/x"
    assert changes.changeset_number("tfvc:42") == 42 and changes.changeset_number("none") is None
    assert changes.parse_tfs_status(["Change      : delete", "Local item : [PC] C:\\a.cs"]) == [("C:\\a.cs", "delete")]


def test_scopes(spark):
    row = lambda root, status="completed", alias="x": (root, root + "id", root + "c", [], [], None, 1, 1, False, None, None, None, None, root, [alias], status)
    from siltstone import schemas as S

    registry = spark.createDataFrame([row("/w"), row("/w/in", alias="Inner"), row("/busy", "indexing"), row("/odd", "what")], S.REGISTRY)
    groups = spark.createDataFrame([("G", "shared", ["/W", "/none"], [], False)], S.GROUPS)
    roots = lambda **k: sorted(r.workspace_root for r in catalog.resolve_scope(registry, groups, **k).collect())
    assert roots(scope="all") == ["/odd", "/w", "/w/in"]
    assert roots(workspace_root="/W/in/deep/x.cs") == ["/w/in"]
    assert roots(current="/w/x") == ["/w"] and roots(workspace_root="INNER") == ["/w/in"]
    assert roots(workspace_group=" g ") == ["/w"] and roots(workspace_root="/busy/x") == []
    assert roots(workspace_root="/w/x", expand_groups=True) == ["/w"]
    with pytest.raises(PermissionError):
        catalog.allowed(["/other"], ["/w"])
    catalog.allowed(["/w/x"], ["/W/"])


def test_groups_and_stores(spark, tmp_path):
    from siltstone import schemas as S

    rows = [("a", "shared", ["/1"], [], False), ("A", "local", ["/2"], [], False), ("b", "configured", ["/3"], [], True), ("B", "local", ["/4"], [], False)]
    groups = catalog.overlaid_groups(spark.createDataFrame(rows, S.GROUPS))
    assert sorted((r.name, r.source) for r in groups.collect()) == [("A", "local"), ("b", "configured")]
    for bad in (("b", "shared", ["/5"], [], False), ("c", "shared", [], [], False)):
        with pytest.raises(Exception, match="group"):
            catalog.saved_group(groups, spark.createDataFrame([bad], S.GROUPS)).collect()
    s = store.VectorStore(spark, f"{tmp_path}/s")
    points = lambda *ids: spark.createDataFrame([(i, [float(len(i)), 0.0], "w", f"/x/{i}") for i in ids], "point_id string, embedding array<float>, workspace_id string, file_path string")
    assert s.upsert("t", points("a", "b", "cc")) == 1 and s.upsert("t", points("b", "d")) == 2
    s.delete_files("t", "w", points("A").select("file_path"))
    s.delete_directories("t", "other", ["/x"])
    assert sorted(r.point_id for r in s.read("t").collect()) == ["b", "cc", "d"] and len(s.versions("t")) == 2
    with pytest.raises(Exception, match="vector of width"):
        s.build("t", points("a"), width=3)
    s.drop("t")
    s.drop("never there")
    with pytest.raises(LookupError):
        s.read("t")


def test_solution_scope(spark):
    files = {
        "/w/all.sln": 'Project("{X}") = "A", "a\\A.csproj", "{Y}"\nProject("{X}") = "No", "no\\No.csproj", "{Y}"',
        "/w/a/A.csproj": '<Project><ItemGroup><projectreference include="..\\b\\B.csproj" /></ItemGroup></Project>',
        "/w/b/B.csproj": "<Project xmlns:m='x'><m:ProjectReference Include='../a/A.csproj'/></Project>",
        "/w/b/Bad.csproj": "<Project><ProjectReference Include='../c/C.csproj'></Project>", "/w/c/C.csproj": "<Project/>",
        "/w/a/x.cs": "", "/w/b/deep/y.cs": "", "/w/c/z.cs": "", "/w/Directory.Build.props": "", "/other/global.json": "",
    }
    df = spark.createDataFrame(list(files.items()), "file_path string, content string")
    got = sorted(r.file_path for r in solution.solution_scope(df, "/w/all.sln", "/w").collect())
    assert got == ["/w/Directory.Build.props", "/w/a/A.csproj", "/w/a/x.cs", "/w/all.sln", "/w/b/B.csproj", "/w/b/Bad.csproj", "/w/b/deep/y.cs"]
    assert {(r.file_path, r.project) for r in solution.project_references(df).collect()} == {("/w/a/A.csproj", "/w/b/B.csproj"), ("/w/b/B.csproj", "/w/a/A.csproj")}
    assert solution.detected_root(df, "/w/a/sub").first().root == "/w"
    assert solution.detected_root(df, "/none/x").first().root == "/none/x"


def test_embedding_once_with_errors_kept(spark):
    class Picky(embedding.HashingProvider):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("cannot")
            return super().embed(texts)

    chunks = spark.createDataFrame([("1", "same"), ("2", "same"), ("3", "bad"), ("4", "other")], "id string, content string").coalesce(1)
    got = {r.id: r for r in embedding.embedded(chunks, Picky(8), batch=2).collect()}
    assert got["1"].embedding == got["2"].embedding and len(got["4"].embedding) == 8
    assert got["3"].embedding is None and got["3"].embedding_error == "cannot"
    models = embedding.ModelCatalog([{"name": "b:latest"}, {"model": "a"}, {"name": "B:latest"}])
    assert models.names == ["a", "b:latest"] and models.resolve("B") == ("b:latest", False) and models.resolve("z", "a", True) == ("a", True)
    with pytest.raises(LookupError):
        models.resolve("z", "a")


def test_scanners(spark):
    cs = 'namespace N\n{\n  public record P(int X);\n  class C<T> : B where T : class\n  {\n    int a = 1, b;\n    public string S => "{";\n    public int this[int i] => i;\n    void M(int x = 1) { if (x > 0) { } }\n  }\n  enum E { A, B }\n}\n'
    got = [(u.symbol, u.kind, u.start, u.end, u.fqn) for u in scanners.scan_csharp("/x/c.cs", cs)]
    assert got == [
        ("P", "RecordDeclarationSummary", 3, 3, "N.P"),
        ("C", "ClassDeclarationSummary", 4, 10, "N.C"),
        ("a, b", "FieldDeclaration", 6, 6, "N.C.a, b"),
        ("S", "PropertyDeclaration", 7, 7, "N.C.S"),
        ("M", "MethodDeclaration", 9, 9, "N.C.M"),
        ("E", "EnumDeclarationSummary", 11, 11, "N.E"),
    ]
    js = "import a from 'a'\nexport class K {\n  m() { function inner() {} }\n}\n@deco\nconst Comp = () => {\n  return 1\n}\nexport const v = 1;\nconst x = memo(() => null);\n<Route path=\"/p\" element={1} />\n"
    assert [(u.symbol, u.kind, u.start, u.end) for u in scanners.scan_script("a.ts", js)] == [
        ("module dependencies", "ImportsExports", 1, 1), ("K", "Class", 2, 4), ("Comp", "Component", 5, 8), ("v", "Export", 9, 9), ("x", "Function", 9, 10), ("/p", "Route", 11, 11),
    ]
    page = '@page "/x"\n@using A\n<button id="go" @onclick="F">\nx</button>\n<div>\n</div>\n@code {\n int a;\n}\n'
    assert [(u.symbol, u.kind, u.start, u.end) for u in scanners.scan_markup("a.razor", page)] == [("directives", "Directives", 1, 2), ("button#go", "BoundElement", 3, 4), ("@code", "CodeBlock", 7, 9)]
    assert [(u.symbol, u.kind, u.start, u.end) for u in scanners.scan_styles("a.css", "@media x {\n .a { b: c }\n}\n.d { e: f }")] == [("@media x", "StyleAtRule", 1, 3), (".a", "StyleRule", 2, 2), (".d", "StyleRule", 4, 4)]
    sheet = spark.createDataFrame([("/w", "/w/a.css", "@media x {\n .a { b: c }\n}\n.d { e: f }")], "workspace_root string, file_path string, content string")
    assert [(u.symbol, u.kind, u.start_line, u.end_line) for u in blocks.style_units(sheet).orderBy("start_line").collect()] == [("@media x", "StyleAtRule", 1, 3), (".a", "StyleRule", 2, 2), (".d", "StyleRule", 4, 4)]
    assert [u.kind for u in scanners.scan_csharp("a.cs", "")] == ["File"]


def test_remap_takes_the_longest_root(spark):
    df = spark.createDataFrame([("/a/b/x",), ("/a/c",), ("/z",)], "p string")
    assert [r[0] for r in df.select(transfer.mapped_root(F.col("p"), {"/a": "/new", "/A/b/": "/deep/"})).collect()] == ["/deep/x", "/new/c", None]


def test_trigger_stream(spark, tmp_path):
    rows = [(1, "/w", None, None, None), (2, None, "g", None, "boom"), (3, None, None, "repo", None), (4, " ", None, "", None)]
    shape = "event_id int, workspace_path string, workspace_group string, repository_url string, error string"
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/in")
    triggers.run_stream(triggers.file_stream(spark, f"{tmp_path}/in", shape), triggers.status_sink(f"{tmp_path}/out"), f"{tmp_path}/cp")
    assert {r.event_id: r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "Completed", 2: "Failed", 3: "Queued", 4: "Rejected"}
    log = spark.createDataFrame([(i, i) for i in range(5)], "event_id int, ts int")
    assert sorted(r.event_id for r in triggers.merged_log(log, spark.createDataFrame([(4, 4), (9, 9)], "event_id int, ts int"), 3).collect()) == [3, 4, 9]


def test_options():
    assert delimited(["a;b", " c,d "]) == ["a", "b", "c", "d"] and path_map(["/a=/b"]) == {"/a": "/b"}
    with pytest.raises(Exception, match="old=new"):
        path_map(["x"])
    a = parser().parse_args(["--store", "s", "index", "/r", "-x", "a;b", "-x", "c", "-f"])
    assert a.force and delimited(a.exclude) == ["a", "b", "c"]
    assert main(["--store", "s", "profile"]) == 0


def test_engine_end_to_end(spark, tmp_path):
    ws = tmp_path / "ws"
    for name, text in {"src/A.cs": "class A { void M() { } }", "docs/x.md": "# One\ntext about tokens\n# Two\nmore\n", "bin/skip.md": "# no\n", "y.g.cs": "class G {}"}.items():
        os.makedirs((ws / name).parent, exist_ok=True)
        (ws / name).write_text(text)
    e = Engine(spark, f"{tmp_path}/store")
    first = e.index_workspace(str(ws))
    assert (first.files_scanned, first.files_changed, first.chunks_indexed, first.full_reindex) == (2, 2, 4, False)
    again = e.index_workspace(str(ws))
    assert (again.files_changed, again.chunks_indexed) == (0, 0)
    (ws / "docs/x.md").write_text("# One\ntext about tokens\n# New\nother\n")
    os.remove(ws / "src/A.cs")
    plan = {os.path.basename(r.file_path): (r.changed, r.deleted) for r in e.index_workspace(str(ws), dry_run=True).collect()}
    assert plan == {"x.md": (True, False), "A.cs": (False, True)}
    third = e.index_workspace(str(ws))
    assert (third.files_changed, third.files_deleted) == (1, 1)
    assert e.status(str(ws)).first().chunks == 2
    best = e.hybrid_search("text about tokens", scope="all").orderBy("rank").first()
    assert best.symbol_name == "One"
    assert [r.text for r in e.get_code_context(f"{ws}/docs/x.md", 2, 1, 0).orderBy("line").collect()] == ["    1: # One", "    2: text about tokens"]
    assert e.get_symbol_details(f"{ws}/docs/x.md", "NEW").first().start_line == 3
    _, m = e.evaluate('{"queries": [{"query": "text about tokens", "expected": {"file": "docs/x.md", "symbol": "One"}}]}')
    assert m.first().pass_rate == 1.0
    e.export_workspace(str(ws), f"{tmp_path}/out")
    e.import_workspace(f"{tmp_path}/out", {str(ws): "/moved"})
    assert e.search_code("tokens", workspace_root="/moved/docs").first().file_path == "/moved/docs/x.md"
    assert e.adopt_workspace(str(ws)) == {"points_scanned": 2, "files": 1, "missing": 0}
    assert e.index_workspace(str(ws)).files_changed == 0
    e.migrate_workspace("/moved", "/again")
    assert e.search_code("tokens", workspace_root="/again/docs").first().file_path == "/again/docs/x.md"
    e.save_group("g", [str(ws)])
    assert [r.files_changed for r in e.index_group("G")] == [0]
    assert e.trigger_indexing({"workspace_path": str(ws), "index_profile": "bad"})["status"] == "Failed"
    e.delete_workspace(str(ws))
    assert [r.workspace_root for r in e.registry().collect()] == ["/again"]


def test_json_files(spark, tmp_path):
    from datetime import datetime

    from siltstone import schemas as S
    from siltstone.sources import json_files as J

    rows = [(f"/w/{i}", f"sha256:{i}", i, datetime(2024, 1, 2, 3, 4, 5), 1) for i in range(1500)]
    state = spark.createDataFrame(rows, S.FILE_STATE)
    J.write_state(state, f"{tmp_path}/state", "/w", "m")
    assert sorted(map(tuple, J.read_state(spark, f"{tmp_path}/state").collect())) == sorted(rows)
    path = f"{tmp_path}/groups.json"
    assert J.read_local_groups(spark, path).count() == 0
    J.write_local_group(path, "A", ["/1"])
    J.write_local_group(path, " a ", ["/2"], ["bin"])
    J.write_local_group(path, "b", ["/3"])
    J.delete_local_group(path, "B")
    assert [tuple(r) for r in J.read_local_groups(spark, path).collect()] == [("a", "local", ["/2"], ["bin"], False)]
    with pytest.raises(ValueError):
        J.write_local_group(path, "c", [])
    put = J.progress_lines(f"{tmp_path}/p")
    put(J.Progress("/w", "scan", 1, None, "x"))
    assert '"stage": "scan"' in open(f"{tmp_path}/p").read()


def plain_rules(text):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out = []
    for k, x in enumerate(lines):
        if m := re.search(r"^\s*((?:@[\w-]+[^{]+|[^{}]+))\s*\{", x):
            balance = 0
            for last in range(k, len(lines)):
                balance += lines[last].count("{") - lines[last].count("}")
                if balance <= 0:
                    break
            out.append((m[1].strip(), "StyleAtRule" if m[1].strip().startswith("@") else "StyleRule", k + 1, last + 1, "\n".join(lines[k : last + 1])))
    return out or [("s.css", "File", 1, len(lines), "\n".join(lines))]


def test_style_rules_against_a_loop(spark):
    rng = random.Random(6)
    bits = ["a {", "@media x {", "}", "} }", ".b { c: d }", " e: f;", "{", "x } y {", "", "h { i { j", "}}} k {", "\tp , q {"]
    texts = ["\n".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(150)] + ["", "no rules", "a {\r\n}\rb { }"]
    files = spark.createDataFrame([("/w", f"/w/{k}/s.css", t) for k, t in enumerate(texts)] + [("/w", "/w/null/s.css", None)], "workspace_root string, file_path string, content string")
    got = {}
    for r in blocks.style_units(files).collect():
        got.setdefault(r.file_path, []).append((r.symbol, r.kind, r.start_line, r.end_line, r.content))
    assert {k: sorted(v) for k, v in got.items()} == {f"/w/{k}/s.css": sorted(plain_rules(t)) for k, t in enumerate(texts)} | {"/w/null/s.css": plain_rules("")}


def test_parts_are_computed_once(spark):
    files = spark.createDataFrame([("/w", "/w/a.yml", "x")], "workspace_root string, file_path string, content string")
    plan = chunking.metadata_chunks(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "Join" not in chunking.documentation_chunks(files)._jdf.queryExecution().optimizedPlan().toString()


def test_analyzers_of_paths_that_one_or_several_accept(spark):
    names = ["docs/a.md", "a.cs", "src/b.html", "docs/b.html", "dockerfile.cs", "appsettings.json", "publish.yml", "c.mdx", "x.tsx", "y.css", "none", "deployment.xml", "dockerfile.md"]
    texts = ["", "<article><h1>x</h1></article>", "<b *ngIf='x' @click='y'>"]
    rows = [("/w", f"/w/{n}", t) for n in names for t in texts]
    files = spark.createDataFrame(rows, "workspace_root string, file_path string, content string")
    args = F.col("file_path"), F.col("workspace_root"), F.col("content")
    got = files.select(C.select_analyzer(*args)["analyzer"].alias("a"), *[C.is_for(n, *args).alias(n) for n in ("csharp", "documentation", "metadata", "script", "markup")])
    for r in got.collect():
        assert [n for n, v in list(r.asDict().items())[1:] if v] == ([r.a] if r.a else [])


def test_lines_of_style_sheets_are_shuffled_once(spark):
    files = spark.createDataFrame([("/w", "/w/s.css", "a { }")], "workspace_root string, file_path string, content string")
    plan = blocks.style_units(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 2 and plan.count("Join ") == 1 and "Union" not in plan


def test_many_queries_keep_the_best_of_a_task(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, size=(2500, 4)).astype(float)
    x[7] = np.inf
    rows = [(2500 - i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0])]
    vectors = spark.createDataFrame(rows, "point_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(i, x[i + 10].tolist()) for i in range(1100)], "query_id long, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        # a task gives k rows a query, however many batches it reads
        assert search._best_of_block(vectors, queries.limit(20).collect(), 3, "point_id").count() == 60
        got = search.batched_topk(vectors, queries, 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x[7] = 0
    units = np.divide(x, (n := np.linalg.norm(x, axis=1))[:, None], out=np.zeros_like(x), where=n[:, None] > 0)
    ids = np.append(2500 - np.arange(2500), [9000, 9001])
    want = []
    for i in range(1100):
        scores = np.append(np.round(units @ units[i + 10], 6) + 0.0, [0.0, 0.0])
        want += [(i, int(ids[j]), float(scores[j]), place + 1) for place, j in enumerate(np.lexsort((ids, -scores))[:3])]
    assert sorted((r.query_id, r.point_id, r.score, r["rank"]) for r in got) == sorted(want)


def test_memory_of_a_search_does_not_follow_rows_times_queries(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(x))], names=["point_id", "embedding"])

    class Caught:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    run = search._best_of_block(Caught(), [Row(query_id=i, vector=v.tolist()) for i, v in enumerate(x)], 10, "point_id")
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter([batch]))) == 30_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6  # one array of all pairs is 72 MB
