"""Scalar functions on small rows with known answers."""

import pytest
from pyspark.sql import functions as F

from siltstone import schemas as S
from siltstone.functions import classify as C
from siltstone.functions import keys as K
from siltstone.functions import paths as P
from siltstone.functions import text as T
from siltstone.functions.vectors import cosine, cosine_to
from siltstone.operators.chunking import brace_ends, sections, split_lines, split_text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def paths(spark, make, values):
    df = spark.createDataFrame([(v,) for v in values], "p string")
    return [r[0] for r in df.select(make(F.col("p"))).collect()]


def test_names_have_one_canonical_form():
    assert [S.normal_profile(x) for x in (None, " Docs ", "UI", "web", "test", "Documentation")] == ["all", "docs", "frontend", "frontend", "tests", "docs"]
    assert S.normal_content_type(" ALL ") is None and S.normal_content_type("Code") == "code"
    assert S.normal_mode("") == "balanced"
    assert S.normal_scope("all_indexed") == "all" and S.normal_scope("all", workspace_root="/x") == "root" and S.normal_scope(None, "/x", "g") == "group"
    assert [S.clamp_limit(x) for x in (None, 0, 7, 99)] == [10, 1, 7, 50]
    for f, bad in ((S.normal_profile, "x"), (S.normal_content_type, "x"), (S.normal_mode, "x"), (S.normal_scope, "x"), (S.check_schema_version, 1)):
        with pytest.raises(ValueError):
            f(bad)
    S.check_schema_version(" ")


def test_paths(spark):
    assert paths(spark, P.normalise, ["C:/a\\b/", "/a\\b/", "/", "\\\\srv\\x\\"]) == ["C:\\a\\b", "/a/b", "/", "\\\\srv\\x"]
    assert paths(spark, P.extension, ["/a/B.CS", "/a/.gitignore", "noext", "x.tar.GZ"]) == [".cs", ".gitignore", "", ".gz"]
    assert paths(spark, lambda p: P.is_under(p, F.lit("/Ws/")), ["/ws", "/WS/a", "/wsx/a", None]) == [True, True, False, None]
    assert paths(spark, lambda p: P.relative(p, F.lit("/ws")), ["/ws/A/b.cs", "/other"]) == ["A/b.cs", None]
    docs = lambda p: P.matches_glob(p, F.lit("/ws"), ["**/docs/**"])
    assert paths(spark, docs, ["/ws/docs/x.md", "/ws/a/docs/b/x.md", "/ws/mydocs/x.md"]) == [True, True, False]
    assert paths(spark, lambda p: P.excluded_directory(p, F.lit("/ws"), ["bin", "a/b"]), ["/ws/x/BIN/f", "/ws/a/b/f", "/ws/x/a/b/f", "/ws/bin"]) == [True, True, False, False]
    assert paths(spark, lambda p: P.excluded_root(p, F.lit("/ws"), ["bin", "a/b"]), ["/ws/x/Bin/y/f", "/ws/x/a/b/f", "/ws/bin"]) == ["/ws/x/Bin", "/ws/x/a/b", None]
    assert paths(spark, lambda p: P.excluded_file(p, F.lit("/ws"), ["*.g.cs", "gen?/*.txt"]), ["/ws/a/X.G.cs", "/ws/gen1/a/b.txt", "/ws/gen/a.txt"]) == [True, True, False]


def test_classes(spark):
    assert paths(spark, C.guessed_content_type, ["a.md", "x.rst", "/d/Dockerfile", "a.yaml", "b.cshtml", "a.slnx"]) == ["documentation", "code", "project_metadata", "project_metadata", "markup", "code"]
    assert paths(spark, lambda p: C.index_profile(p, F.lit("code")), ["/a/Tests/x.cs", "/a/FooTest.cs", "/ui/x.cs", "/a/x.vue", "/a/x.cs"]) == ["tests", "tests", "frontend", "frontend", "code"]
    roles = paths(spark, lambda p: C.metadata_role(p)["role"], ["a.sln", "Directory.Packages.props", "x.targets", "appsettings.Dev.json", "/r/.github/workflows/ci.yml", "k.yml", "Dockerfile.dev"])
    assert roles == ["DotNetSolution", "CentralPackageManagement", "MSBuildMetadata", "ApplicationSettings", "CiWorkflow", "DeploymentMetadata", "DockerMetadata"]


def test_analyzer_of_ambiguous_markup(spark):
    article = "<article><h1>Guide</h1><p>" + "words of text " * 6 + "</p><p>" + "more words here " * 5 + "</p></article> mkdocs"
    template = '<App-Root *ngIf="x"></App-Root><My-List (click)="go()"></My-List><Side-Bar></Side-Bar>'
    df = spark.createDataFrame([("/w/x.html", article), ("/w/x.html", template), ("/w/docs/x.html", template), ("/w/src/x.html", article), ("/w/a.exe", "")], "p string, c string")
    got = [r[0] and r[0].analyzer for r in df.select(C.select_analyzer(F.col("p"), F.lit("/w"), F.col("c"))).collect()]
    assert got == ["documentation", "markup", "documentation", "markup", None]


def test_text(spark):
    estimate = paths(spark, T.token_estimate, ["", "a b, c_1!", "x" * 400, "日本 🙂"])
    assert estimate == [0, 5, 100, 2]
    assert one(spark, p=T.preview(F.lit("x" * 401)))["p"] == "x" * 400 + "..."
    score = lambda q: one(spark, s=T.keyword_score(F.lit("The Quick fox"), F.lit(q)))["s"]
    assert [score(q) for q in ("quick FOX", "quick quick none", "  ", "ick")] == [1.0, pytest.approx(2 / 3), 0.0, 1.0]
    assert one(spark, n=T.numbered_line(F.lit(7), F.lit("x")))["n"] == "    7: x"
    assert one(spark, n=T.strip_code(F.lit('a("}"); // } http://x')))["n"] == 'a(""); '
    assert one(spark, e=T.element_symbol(F.lit("a"), F.lit("<a class='b c' id=\"z\">")))["e"] == "a#z"
    header = T.member_header(F.lit("N.A"), F.lit("N"), F.lit(None).cast("string"), F.lit(" "), F.lit("body"))
    assert one(spark, h=header)["h"] == "Symbol: N.A\nNamespace: N\n\nbody"


def test_keys(spark):
    same = paths(spark, K.workspace_id, ["C:\\Work", "c:/work/", "/work", "/Work"])
    assert same[0] == same[1] and same[2] != same[3] and len(same[0]) == 32
    guid = one(spark, g=K.point_id(F.lit("w"), F.lit("c")))["g"]
    assert guid[14 + 2 - 2] in "0123456789abcdef" and guid.split("-")[2][2] == "5" and guid.split("-")[3][0] in "89ab"
    assert paths(spark, K.collection_prefix, ["  My Prefix!! ", "--", "A" * 80]) == ["my-prefix", "siltstone", "a" * 64]
    assert one(spark, s=K.staging_name(F.lit("siltstone-" + "a" * 32), F.lit("2024-01-02").cast("timestamp"), F.lit("u")))["s"].startswith("siltstone-" + "a" * 32 + "-stage-20240102")
    assert one(spark, f=K.content_fingerprint(F.lit("x")))["f"].startswith("sha256:2D711642")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(cosine_to(F.col("a"), [3.0, 0.0])).collect()] == [1.0, 1.0, 0.0, 0.0, 0.0]


def plain_split(text, max_chars=1500, max_tokens=384):
    import re

    est = lambda s: max(len(re.findall(r"[^\W]+|[^\w\s]", s)), (len(s) + 3) // 4) if s else 0
    lines = text.split("\n")
    if len(text) <= max_chars and est(text) <= max_tokens:
        return [(0, len(lines) - 1, text)]
    parts, buf, chars, toks = [], [], 0, 0
    for i, x in enumerate(lines):
        if len(x) + 1 > max_chars or est(x) > max_tokens:
            if buf:
                parts.append((i - len(buf), i - 1, "\n".join(buf)))
            count = max(-(-len(x) // max_chars), -(-est(x) // max_tokens))
            size = -(-len(x) // count)
            parts += [(i, i, x[k : k + size]) for k in range(0, len(x), size)]
            buf, chars, toks = [], 0, 0
            continue
        if buf and (chars + len(x) + 1 > max_chars or toks + est(x) > max_tokens):
            parts.append((i - len(buf), i - 1, "\n".join(buf)))
            buf, chars, toks = [], 0, 0
        buf.append(x)
        chars += len(x) + 1
        toks += est(x)
    if buf:
        parts.append((len(lines) - len(buf), len(lines) - 1, "\n".join(buf)))
    return parts


def test_split_matches_a_plain_loop(spark):
    import random

    rng = random.Random(1)
    texts = ["", "one line", "x" * 4000, "\n".join("y" * rng.randint(0, 300) for _ in range(60)), "! " * 900, "a\n" * 2000]
    texts += ["\n".join(rng.choice(["", "short", "word " * rng.randint(1, 60), "z" * rng.randint(1400, 1700)]) for _ in range(rng.randint(1, 40))) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(p["first"], p["last"], p["text"]) for p in r.ps] for r in df.select("i", split_text(F.col("t")).alias("ps")).collect()}
    assert got == {i: plain_split(t) for i, t in enumerate(texts)}
    uncut = spark.createDataFrame([("a" * 800 + "\nb\n" + "c" * 749,)], "t string").select(split_lines(F.col("t")).alias("ps")).first().ps
    assert [(p["first"], p["last"]) for p in uncut] == [(0, 0), (1, 1), (2, 2)]


def test_sections_by_language(spark):
    rows = [("/a.md", "pre\n# One #\nx\n  ## Two\ny"), ("/a.txt", "# no\nplain"), ("/a.rst", "Title\n=====\ntext\nab\n--\n"), ("/a.adoc", "== Top\nx"), ("/a.html", "<h1 a='1'>One <b>b</b></h1>\n<p>")]
    got = sections(spark.createDataFrame(rows, "file_path string, content string")).collect()
    assert sorted((r.file_path, r.title, r.start_line, r.end_line, r.symbol_kind) for r in got) == [
        ("/a.adoc", "Top", 1, 2, "DocumentSection"),
        ("/a.html", "One b", 1, 2, "DocumentSection"),
        ("/a.md", "One", 2, 3, "DocumentSection"),
        ("/a.md", "Two", 4, 5, "DocumentSection"),
        ("/a.rst", "Title", 1, 3, "DocumentSection"),
        ("/a.rst", "ab", 4, 6, "DocumentSection"),
        ("/a.txt", "a.txt", 1, 2, "Document"),
    ]


def test_brace_balance(spark):
    code = ["a {", ' b("{"); // }', "  c { }", "}"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(code)], "file_path string, line int, text string")
    assert [r.balance for r in brace_ends(df).orderBy("line").collect()] == [1, 1, 1, 0]
