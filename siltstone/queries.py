"""The engine's registered queries and their SQL, by operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import classify as C
from siltstone.functions import keys as K
from siltstone.functions import paths as P
from siltstone.functions import text as T
from siltstone.operators import ann, blocks, catalog, chunking, delta, embedding, evaluation, scan, scanners, search, solution, store, transfer
from siltstone.plans import fixtures as X
from siltstone.sources.changes import webhook
from siltstone.sources import shared
from siltstone.sources.tables import table
from siltstone.streaming import triggers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- search


def _ask(spark: SparkSession, sf_dir: str, **more) -> search.Search:
    return search.Search(vector=X.query_vector(spark, sf_dir), text=X.query_text(spark, sf_dir), **more)


@query("vector_topk", f"WITH {X.VECTORS} SELECT point_id, score, row_number() OVER (ORDER BY score DESC, point_id) AS rank FROM sem ORDER BY score DESC, point_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return search.top(search.semantic(X.vectors(spark, sf_dir), X.query_vector(spark, sf_dir)), 10).select("point_id", "score", "rank")


@query(
    "vector_topk_filtered",
    f"WITH {X.VECTORS} SELECT point_id, score, row_number() OVER (ORDER BY score DESC, point_id) AS rank FROM sem "
    "WHERE content_type = 'code' AND index_profile = 'tests' AND workspace_id = 'w1' ORDER BY score DESC, point_id LIMIT 10",
)
def vector_topk_filtered(spark, sf_dir):
    s = _ask(spark, sf_dir, content_type="Code", index_profile="test").checked()
    rows = search.filtered(X.vectors(spark, sf_dir), s, ["w1"])
    return search.top(search.semantic(rows, s.vector), 10).select("point_id", "score", "rank")


@query(
    "vector_topk_multi_workspace",
    f"WITH {X.VECTORS} SELECT workspace_id, point_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY score DESC, point_id) "
    "AS rank FROM sem) WHERE rank <= 5",
)
def vector_topk_multi_workspace(spark, sf_dir):
    rows = search.semantic(X.vectors(spark, sf_dir), X.query_vector(spark, sf_dir))
    return search.top(rows, 5, ["workspace_id"]).select("workspace_id", "point_id", "score", "rank")


@query(
    "vector_topk_batched",
    "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS point_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score "
    "FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) "
    "AS rank FROM s) WHERE rank <= 10",
)
def vector_topk_batched(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.batched_topk(e.withColumnRenamed("vec_id", "point_id"), asked, 10)


def _by_lists(spark, sf_dir, every: bool) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding")
    folder = shared.folder(spark, "lists")
    books = ann.fit(e)
    ann.save(ann.indexed(e, books, whole=every), books, folder)
    blocks, books = ann.load(spark, folder)
    asked = e.filter("point_id % 100 = 0").select(F.col("point_id").alias("query_id"), F.col("embedding").alias("vector"))
    if every:
        return ann.exact_topk(e, blocks, books, asked, 10)
    probes, rescore = ann.tuned(e, blocks, books, 10)[:2]
    return ann.approximate_topk(e, blocks, books, asked, 10, probes, rescore)


@query("vector_topk_approximate")
def vector_topk_approximate(spark, sf_dir):
    """By as many lists and candidates as a recall of 0.95 takes; a test holds it against the exact search."""
    return _by_lists(spark, sf_dir, False)


@query(
    "vector_topk_all_lists",
    """WITH s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS point_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s) WHERE rank <= 10""",
)
def vector_topk_all_lists(spark, sf_dir):
    """By all lists the index gives what the exact search gives."""
    return _by_lists(spark, sf_dir, True)


@query("keyword_score", f"WITH {X.VECTORS} SELECT doc_id, round(len(list_filter(ts, lambda t: contains(lower(coalesce(text, '')), lower(t)))) / CAST(len(ts) AS DOUBLE), 6) AS score FROM documents, words")
def keyword_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    share = T.keyword_score(F.coalesce("text", F.lit("")), F.lit(X.query_text(spark, sf_dir)))
    return d.select("doc_id", F.round(share, 6).alias("score"))


@query("hybrid_exact", f"WITH {X.VECTORS}, h AS (SELECT point_id, round(cos + share, 6) AS score FROM kw) SELECT *, row_number() OVER (ORDER BY score DESC, point_id) AS rank FROM h ORDER BY score DESC, point_id LIMIT 10")
def hybrid_exact(spark, sf_dir):
    return search.hybrid_exact(X.vectors(spark, sf_dir), _ask(spark, sf_dir), 10).select("point_id", "score", "rank")


@query(
    "hybrid_rerank",
    f"WITH {X.VECTORS}, f AS (SELECT * FROM kw ORDER BY cos DESC, point_id LIMIT 50), h AS (SELECT point_id, round(cos + share, 6) AS score FROM f) "
    "SELECT *, row_number() OVER (ORDER BY score DESC, point_id) AS rank FROM h ORDER BY score DESC, point_id LIMIT 10",
)
def hybrid_rerank(spark, sf_dir):
    return search.hybrid_rerank(X.vectors(spark, sf_dir), _ask(spark, sf_dir), 10).select("point_id", "score", "rank")


@query(
    "retrieval_mode_boost",
    f"WITH {X.VECTORS} SELECT point_id, score * CAST(CASE content_type WHEN 'documentation' THEN 1.15 WHEN 'project_metadata' THEN 1.05 ELSE 1.0 END AS DOUBLE) AS docs_first, "
    "score * CAST(CASE content_type WHEN 'code' THEN 1.15 WHEN 'markup' THEN 1.05 ELSE 1.0 END AS DOUBLE) AS code_first, score AS balanced FROM sem",
)
def retrieval_mode_boost(spark, sf_dir):
    rows = search.semantic(X.vectors(spark, sf_dir), X.query_vector(spark, sf_dir))
    boost = {m: (F.col("score") * C.mode_boost(m, F.col("content_type"))).alias(m) for m in ("docs_first", "code_first", "balanced")}
    return rows.select("point_id", *boost.values())


_IN = {
    "all": "true",
    "code": "index_profile = 'code' OR content_type = 'code'",
    "docs": "index_profile = 'docs' OR content_type = 'documentation'",
    "metadata": "index_profile = 'metadata' OR content_type = 'project_metadata'",
    "frontend": "index_profile = 'frontend' OR content_type = 'markup' OR language IN ('javascript', 'typescript', 'jsx', 'tsx', 'html', 'css')",
    "tests": "index_profile = 'tests' OR regexp_matches(file_path, '(?i)/tests?/|tests?[.][^./]*$') OR contains(symbol_name, 'test')",
}


@query("search_profile_filter", f"WITH {X.VECTORS} SELECT point_id, {', '.join(f'({v}) AS in_{k}' for k, v in _IN.items())} FROM vectors")
def search_profile_filter(spark, sf_dir):
    columns = [F.col(c) for c in ("index_profile", "content_type", "language", "file_path", "symbol_name")]
    return X.vectors(spark, sf_dir).select("point_id", *[C.in_search_profile(p, *columns).alias(f"in_{p}") for p in _IN])


# ranked hits of every symbol as one query each, so that merging has something to do
_PACK_SQL = f"""WITH RECURSIVE {X.VECTORS},
h AS (SELECT abs(hash_group) AS query_id, * FROM (SELECT CAST(point_id // 16 AS BIGINT) AS hash_group, * FROM sem)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS i,
  file_path || '|' || content_type || '|' || symbol_name AS key FROM h),
walk AS (
  SELECT query_id, CAST(0 AS BIGINT) AS i, [] :: STRUCT(key VARCHAR, s INTEGER, e INTEGER, score DOUBLE, cur BOOLEAN)[] AS o FROM (SELECT DISTINCT query_id FROM r)
  UNION ALL
  SELECT w.query_id, r.i, CASE WHEN len(o) >= 3 THEN o
    WHEN len(list_filter(o, lambda x: x.cur AND x.key = r.key AND x.s <= r.end_line + 1 AND r.start_line <= x.e + 1)) > 0 THEN
      list_transform(o, lambda x: CASE WHEN x.cur AND x.key = r.key AND x.s <= r.end_line + 1 AND r.start_line <= x.e + 1
        THEN {{'key': x.key, 's': least(x.s, r.start_line), 'e': greatest(x.e, r.end_line), 'score': greatest(x.score, r.score), 'cur': x.cur}} ELSE x END)
    ELSE list_append(list_transform(o, lambda x: {{'key': x.key, 's': x.s, 'e': x.e, 'score': x.score, 'cur': x.cur AND x.key <> r.key}}),
      {{'key': r.key, 's': r.start_line, 'e': r.end_line, 'score': r.score, 'cur': true}}) END
  FROM walk w JOIN r ON r.query_id = w.query_id AND r.i = w.i + 1),
last AS (SELECT query_id, arg_max(o, i) AS o FROM walk GROUP BY query_id)
SELECT query_id, k AS rank, o[k].s AS start_line, o[k].e AS end_line, o[k].score AS score FROM (SELECT query_id, o, unnest(range(1, len(o) + 1)) AS k FROM last)"""


@query("pack_results", _PACK_SQL)
def pack_results(spark, sf_dir):
    rows = search.semantic(X.vectors(spark, sf_dir), X.query_vector(spark, sf_dir))
    rows = rows.withColumn("query_id", F.floor(F.col("point_id") / 16))
    return search.packed(rows, 3).select("query_id", F.col("rank").cast("long").alias("rank"), "start_line", "end_line", "score")


@query("search_code")
def search_code(spark, sf_dir):
    return search.search(X.vectors(spark, sf_dir), _ask(spark, sf_dir, limit=10, mode="code_first"))


@query("hybrid_search")
def hybrid_search(spark, sf_dir):
    return search.search(X.vectors(spark, sf_dir), _ask(spark, sf_dir, limit=10, hybrid=True, profile="docs"), ["w0", "w1", "w2"])


# --- scalars

_TOK = r"[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s\p{Z}]"


@query("token_estimate", rf"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE CAST(greatest(len(regexp_extract_all(text, '{_TOK}')), (length(text) + 3) // 4) AS INTEGER) END AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).cast("int").alias("tokens"))


@query(
    "preview",
    "SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS preview, "
    "CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '...' ELSE text END AS packed FROM documents",
)
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.packed_preview(F.col("text")).alias("packed"))


@query(
    "path_parts",
    f"WITH {X.FILES}, p AS (SELECT doc_id, file_path, regexp_extract(file_path, '([^/]*)$', 1) AS name FROM files) SELECT doc_id, name, "
    r"lower(regexp_extract(name, '(\.[^.]+)$', 1)) AS ext, regexp_replace(name, '\.[^.]*$', '') AS stem, "
    "regexp_replace(file_path, '/?[^/]*$', '') AS directory, substr(file_path, 5) AS below FROM p",
)
def path_parts(spark, sf_dir):
    p = F.col("file_path")
    return X.files(spark, sf_dir).select(
        "doc_id", P.file_name(p).alias("name"), P.extension(p).alias("ext"), P.stem(p).alias("stem"), P.directory(p).alias("directory"), P.relative(p, F.lit("/WS/")).alias("below")
    )


def _case(languages: dict[str, str], default: str) -> str:
    return "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in languages.items()) + f" ELSE '{default}' END"


_EXT = rf"{X.FILES}, e AS (SELECT *, lower(regexp_extract(file_path, '(\.[^./]+)$', 1)) AS ext, lower(regexp_extract(file_path, '([^/]*)$', 1)) AS name FROM files)"


@query(
    "language_by_extension",
    f"WITH {_EXT} SELECT doc_id, {_case(C.DOCUMENTATION_LANGUAGES, 'text')} AS docs, {_case(C.SCRIPT_LANGUAGES, 'javascript')} AS script, "
    f"{_case(C.MARKUP_LANGUAGES, 'html')} AS markup, CASE WHEN ext IN ('.jsx', '.tsx') THEN 'markup' ELSE 'code' END AS script_type FROM e",
)
def language_by_extension(spark, sf_dir):
    p = F.col("file_path")
    return X.files(spark, sf_dir).select(
        "doc_id",
        C.language(p, C.DOCUMENTATION_LANGUAGES).alias("docs"),
        C.language(p, C.SCRIPT_LANGUAGES, "javascript").alias("script"),
        C.language(p, C.MARKUP_LANGUAGES, "html").alias("markup"),
        C.script_content_type(p).alias("script_type"),
    )


_TEST = "(regexp_matches(file_path, '(?i)/tests?/') OR regexp_matches(regexp_replace(name, '[.][^.]*$', ''), '(?i)tests?$'))"
_FRONT = "(ext IN ('.jsx', '.tsx', '.vue', '.svelte', '.css', '.scss') OR regexp_matches(file_path, '(?i)(^|/)(frontend|client|ui|wwwroot)(/|$)'))"
_META = (
    "(ext IN ('.sln', '.csproj', '.props', '.targets', '.yml', '.yaml') OR name IN ('directory.packages.props', 'global.json', 'appsettings.json', "
    "'launchsettings.json', 'nuget.config', '.editorconfig', 'dockerfile'))"
)
_GUESS = f"CASE WHEN ext IN ('.md', '.mdx', '.txt') THEN 'documentation' WHEN {_META} THEN 'project_metadata' WHEN ext IN ('.html', '.htm', '.razor', '.cshtml') THEN 'markup' ELSE 'code' END"
_PROFILE = f"CASE WHEN ct = 'documentation' THEN 'docs' WHEN ct = 'project_metadata' THEN 'metadata' WHEN {_TEST} THEN 'tests' WHEN ct = 'markup' OR {_FRONT} THEN 'frontend' ELSE 'code' END"


@query("guess_content_type", f"WITH {_EXT} SELECT doc_id, {_GUESS} AS content_type, {_META} AS is_metadata, {_FRONT} AS is_frontend, {_TEST} AS is_test FROM e")
def guess_content_type(spark, sf_dir):
    p = F.col("file_path")
    return X.files(spark, sf_dir).select("doc_id", C.guessed_content_type(p).alias("content_type"), C.is_metadata_path(p).alias("is_metadata"), C.is_frontend_path(p).alias("is_frontend"), C.is_test_path(p).alias("is_test"))


@query("index_profile", f"WITH {_EXT}, g AS (SELECT *, {_GUESS} AS ct FROM e) SELECT doc_id, {_PROFILE} AS index_profile FROM g")
def index_profile(spark, sf_dir):
    p = F.col("file_path")
    return X.files(spark, sf_dir).select("doc_id", C.index_profile(p, C.guessed_content_type(p)).alias("index_profile"))


_ROLE = """CASE WHEN ext IN ('.sln', '.slnx') THEN 'solution|DotNetSolution' WHEN ext = '.csproj' THEN 'xml|DotNetProject'
 WHEN name = 'directory.packages.props' THEN 'xml|CentralPackageManagement' WHEN ext IN ('.props', '.targets', '.runsettings', '.pubxml') THEN 'xml|MSBuildMetadata'
 WHEN name = 'nuget.config' THEN 'xml|NuGetConfig' WHEN name = 'global.json' THEN 'json|DotNetSdkConfig' WHEN starts_with(name, 'appsettings') THEN 'json|ApplicationSettings'
 WHEN name = 'launchsettings.json' THEN 'json|LaunchSettings' WHEN name = '.editorconfig' THEN 'editorconfig|EditorConfig' WHEN starts_with(name, 'dockerfile') THEN 'dockerfile|DockerMetadata'
 WHEN ext IN ('.yml', '.yaml') THEN CASE WHEN contains(lower(file_path), '/.github/workflows/') THEN 'yaml|CiWorkflow' ELSE 'yaml|DeploymentMetadata' END
 WHEN ext = '.json' THEN 'json|ProjectMetadata' ELSE 'text|ProjectMetadata' END"""


@query("metadata_role", f"WITH {_EXT} SELECT doc_id, split_part({_ROLE}, '|', 1) AS language, split_part({_ROLE}, '|', 2) AS role FROM e")
def metadata_role(spark, sf_dir):
    return X.files(spark, sf_dir).select("doc_id", C.metadata_role(F.col("file_path")).alias("r")).select("doc_id", "r.*")


@query("workspace_id", f"WITH {X.REGISTRY} SELECT custkey, workspace_id, collection_name FROM reg")
def workspace_id(spark, sf_dir):
    return X.registry(spark, sf_dir).select("custkey", "workspace_id", "collection_name")


@query(
    "point_id",
    "WITH d AS (SELECT doc_id, sha256('w:' || doc_id) AS h FROM documents), b AS (SELECT doc_id, list_transform(range(0, 16), lambda i: substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS b, h FROM d), "
    "v AS (SELECT doc_id, b, '5' || substr(h, 14, 1) AS b6, substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 1) AS b8 FROM b) "
    "SELECT doc_id, b[4] || b[3] || b[2] || b[1] || '-' || b[6] || b[5] || '-' || b[8] || b6 || '-' || b8 || b[10] || '-' || b[11] || b[12] || b[13] || b[14] || b[15] || b[16] AS point_id FROM v",
)
def point_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.point_id(F.lit("w"), F.col("doc_id").cast("string")).alias("point_id"))


@query(
    "content_fingerprint",
    "SELECT doc_id, 'sha256:' || upper(sha256(coalesce(text, ''))) AS fingerprint, 'metadata:' || n_chars || ':' || ((1700000000000000 + doc_id * 1000000) * 10 + 621355968000000000) AS cheap, "
    "sha256(substr(coalesce(text, ''), 1, 8000)) AS embedding_key FROM documents",
)
def content_fingerprint(spark, sf_dir):
    return X.files(spark, sf_dir).select(
        "doc_id",
        K.content_fingerprint(F.col("content")).alias("fingerprint"),
        K.metadata_fingerprint(F.col("size"), F.col("last_write_time_utc")).alias("cheap"),
        K.embedding_key(F.col("content")).alias("embedding_key"),
    )


@query(
    "chunk_id",
    r"WITH c AS (SELECT doc_id, source, regexp_replace(regexp_replace(lang || ' (' || source || ')', '[^\p{L}\p{Nd}]', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents) "
    "SELECT doc_id, 'docs/' || source || ':1:' || (doc_id % 50 + 1) || ':' || CASE WHEN s = '' THEN 'chunk' ELSE s END || CASE WHEN doc_id % 4 > 0 THEN ':part:' || (doc_id % 4) ELSE '' END AS id FROM c",
)
def chunk_id(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat("lang", F.lit(" ("), "source", F.lit(")"))
    made = K.chunk_id(F.concat(F.lit("docs/"), "source"), F.lit(1), F.col("doc_id") % 50 + 1, name, F.col("doc_id") % 4)
    return d.select("doc_id", made.alias("id"))


# --- chunking

_SPLIT = rf"""WITH RECURSIVE {X.FILES},
l0 AS (SELECT doc_id, content, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM files),
est AS (SELECT doc_id, content, ls, length(content) > 1500 OR greatest(len(regexp_extract_all(content, '{_TOK}')), (length(content) + 3) // 4) > 384 AS over FROM l0),
ln AS (SELECT doc_id, i, ls[i] AS x, length(ls[i]) AS n, CASE WHEN ls[i] = '' THEN 0 ELSE greatest(len(regexp_extract_all(ls[i], '{_TOK}')), (length(ls[i]) + 3) // 4) END AS t
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM est WHERE over)),
m AS (SELECT *, n + 1 > 1500 OR t > 384 AS alone, greatest(ceil(n / 1500.0), ceil(t / 384.0)) AS want FROM ln),
m2 AS (SELECT *, CASE WHEN alone THEN CAST(ceil(n / want) AS BIGINT) ELSE 1 END AS size FROM m),
m3 AS (SELECT *, CASE WHEN alone THEN CAST(ceil(n / CAST(size AS DOUBLE)) AS BIGINT) ELSE 0 END AS segs FROM m2),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS closed, CAST(0 AS BIGINT) AS bn, CAST(0 AS BIGINT) AS bc, CAST(0 AS BIGINT) AS bt, CAST(0 AS BIGINT) AS part FROM est WHERE over
  UNION ALL
  SELECT w.doc_id, m.i,
    CASE WHEN m.alone THEN w.closed + (w.bn > 0)::BIGINT + m.segs WHEN w.bn > 0 AND (w.bc + m.n + 1 > 1500 OR w.bt + m.t > 384) THEN w.closed + 1 ELSE w.closed END,
    CASE WHEN m.alone THEN 0 WHEN w.bn > 0 AND (w.bc + m.n + 1 > 1500 OR w.bt + m.t > 384) THEN 1 ELSE w.bn + 1 END,
    CASE WHEN m.alone THEN 0 WHEN w.bn > 0 AND (w.bc + m.n + 1 > 1500 OR w.bt + m.t > 384) THEN m.n + 1 ELSE w.bc + m.n + 1 END,
    CASE WHEN m.alone THEN 0 WHEN w.bn > 0 AND (w.bc + m.n + 1 > 1500 OR w.bt + m.t > 384) THEN m.t ELSE w.bt + m.t END,
    CASE WHEN m.alone THEN w.closed + (w.bn > 0)::BIGINT + 1 WHEN w.bn > 0 AND (w.bc + m.n + 1 > 1500 OR w.bt + m.t > 384) THEN w.closed + 2 ELSE w.closed + 1 END
  FROM walk w JOIN m3 m ON m.doc_id = w.doc_id AND m.i = w.i + 1),
placed AS (SELECT m3.*, part FROM m3 JOIN walk USING (doc_id, i)),
parts AS (
  SELECT doc_id, part, min(i) AS a, max(i) AS b, string_agg(x, chr(10) ORDER BY i) AS text FROM placed WHERE NOT alone GROUP BY doc_id, part
  UNION ALL SELECT doc_id, part + k, i, i, substr(x, CAST(k * size + 1 AS BIGINT), size) FROM (SELECT *, unnest(range(0, segs)) AS k FROM placed WHERE alone)
  UNION ALL SELECT doc_id, 1, 1, len(ls), content FROM est WHERE NOT over)
"""


@query("chunk_text_lines", _SPLIT + "SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, md5(text) AS text_md5 FROM parts")
def chunk_text_lines(spark, sf_dir):
    f = X.files(spark, sf_dir)
    doc = F.regexp_extract("file_path", r"/f(\d+)[^/]*$", 1).cast("long")
    return chunking.text_chunks(f).select(doc.alias("doc_id"), "part", "start_line", "end_line", F.md5("content").alias("text_md5"))


@query("chunk_counts", _SPLIT + "SELECT doc_id, count(*) AS parts, sum(length(text)) AS chars, max(length(text)) AS longest FROM parts GROUP BY doc_id")
def chunk_counts(spark, sf_dir):
    doc = F.regexp_extract("file_path", r"/f(\d+)[^/]*$", 1).cast("long")
    chunks = chunking.text_chunks(X.files(spark, sf_dir)).withColumn("doc_id", doc)
    n = F.length("content").cast("long")
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(n).alias("chars"), F.max(n).alias("longest"))


@query(
    "html_sections",
    r"WITH p AS (SELECT page_id, string_split(regexp_replace(coalesce(html, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM pages), "
    "l AS (SELECT page_id, ls, i, trim(regexp_replace(regexp_extract(ls[i], '(?i)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), '<[^>]+>', '', 'g')) AS title FROM (SELECT page_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM p)), "
    "h AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY page_id ORDER BY i) - 1, len(ls)) AS e FROM l WHERE title <> '') "
    "SELECT page_id, title, CAST(i AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, md5(array_to_string(ls[i:e], chr(10))) AS text_md5, 'DocumentSection' AS symbol_kind FROM h "
    "UNION ALL SELECT page_id, page_id || '.html', 1, CAST(len(ls) AS INTEGER), md5(array_to_string(ls, chr(10))), 'Document' FROM p WHERE page_id NOT IN (SELECT page_id FROM h)",
)
def html_sections(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("/ws/docs/"), "page_id", F.lit(".html")).alias("file_path"), F.coalesce("html", F.lit("")).alias("content"))
    page = F.regexp_extract("file_path", r"/(\d+)\.html$", 1).cast("long")
    return chunking.sections(pages).select(page.alias("page_id"), "title", "start_line", "end_line", F.md5("content").alias("text_md5"), "symbol_kind")


@query("documentation_chunks")
def documentation_chunks(spark, sf_dir):
    f = X.files(spark, sf_dir)
    return chunking.documentation_chunks(f.filter(C.accepts(F.col("file_path"))["documentation"]).select("workspace_root", "file_path", "content"))


@query("metadata_chunks")
def metadata_chunks(spark, sf_dir):
    f = X.files(spark, sf_dir)
    return chunking.metadata_chunks(f.filter(C.accepts(F.col("file_path"))["metadata"]).select("workspace_root", "file_path", "content"))


@query("analyzer_selection")
def analyzer_selection(spark, sf_dir):
    f = X.files(spark, sf_dir).select("doc_id", "workspace_root", "file_path", "content")
    p = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.lit("/ws").alias("workspace_root"), F.concat(F.lit("/ws/site/"), "page_id", F.lit(".html")).alias("file_path"), F.coalesce("html", F.lit("")).alias("content"))
    pick = C.select_analyzer(F.col("file_path"), F.col("workspace_root"), F.col("content"))
    return f.unionByName(p).select("doc_id", pick["analyzer"].alias("analyzer"), pick["confidence"].alias("confidence"))




def _scan(analyzer: str) -> Query:
    def run(spark, sf_dir):
        f = X.files(spark, sf_dir)
        return scanners.code_chunks(f.filter(C.accepts(F.col("file_path"))[analyzer]), analyzer)

    return run


query("code_symbols_csharp")(_scan("csharp"))
query("script_symbols")(_scan("script"))
query("markup_elements")(_scan("markup"))

_SHEET = r"""sheet AS (
  SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, text) AS line, text
  FROM (SELECT l_orderkey, l_linenumber, l_partkey,
    CASE l_partkey % 6 WHEN 0 THEN '@media (min-width: ' || l_suppkey || 'px) {' WHEN 1 THEN '  .c' || l_suppkey || ' { color: red }'
      WHEN 2 THEN '  .c' || l_suppkey || ' , p {' WHEN 3 THEN '  }' WHEN 4 THEN '} }' ELSE '  color: blue;' END AS text
    FROM lineitem))"""


@query(
    "style_rules",
    rf"""WITH {_SHEET},
b AS (SELECT *, regexp_matches(text, '^\s*((?:@[\w-]+[^{{]+|[^{{}}]+))\s*\{{') AS starts,
    len(text) - len(replace(text, '{{', '')) - len(text) + len(replace(text, '}}', '')) AS change FROM sheet),
p AS (SELECT *, CAST(sum(change) OVER (PARTITION BY file ORDER BY line) AS BIGINT) AS after, max(line) OVER (PARTITION BY file) AS n FROM b),
r AS (SELECT s.file, s.line, any_value(s.n) AS n, any_value(s.text) AS text, min(e.line) AS last
  FROM p s LEFT JOIN p e ON e.file = s.file AND e.line >= s.line AND e.after <= s.after - s.change WHERE s.starts GROUP BY ALL),
c AS (SELECT file, regexp_replace(split_part(text, '{{', 1), '^\s+|\s+$', '', 'g') AS symbol, line AS start_line, coalesce(last, n) AS end_line FROM r
  UNION ALL SELECT file, file || '.css', 1, max(line) FROM p GROUP BY file HAVING NOT bool_or(starts)),
t AS (SELECT c.file, c.symbol, c.start_line, c.end_line, string_agg(s.text, chr(10) ORDER BY s.line) AS content
  FROM c JOIN sheet s ON s.file = c.file AND s.line BETWEEN c.start_line AND c.end_line GROUP BY ALL)
SELECT '/w/' || file || '.css' AS file_path, symbol, CASE WHEN symbol = file || '.css' THEN 'File' WHEN starts_with(symbol, '@') THEN 'StyleAtRule' ELSE 'StyleRule' END AS kind,
  CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(content) AS content_md5 FROM t""",
)
def style_rules(spark, sf_dir):
    """Orders as style sheets: a line of each item opens or closes rules by its part."""
    item = table(spark, sf_dir, "lineitem")
    c = F.concat(F.lit("  .c"), "l_suppkey")
    kinds = [F.concat(F.lit("@media (min-width: "), "l_suppkey", F.lit("px) {")), F.concat(c, F.lit(" { color: red }")), F.concat(c, F.lit(" , p {")), F.lit("  }"), F.lit("} }"), F.lit("  color: blue;")]
    text = F.element_at(F.array(*kinds), (F.col("l_partkey") % 6 + 1).cast("int"))
    lines = item.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", text.alias("text")))).alias("ls"))
    sheets = lines.select(F.lit("/w").alias("workspace_root"), F.concat(F.lit("/w/"), "l_orderkey", F.lit(".css")).alias("file_path"), F.array_join("ls.text", "\n").alias("content"))
    return blocks.style_units(sheets).select("file_path", "symbol", "kind", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query("chunk_files")
def chunk_files(spark, sf_dir):
    return scanners.chunk_files(X.files(spark, sf_dir).select("workspace_root", "file_path", "content"))


# --- scope


@query(
    "file_exclusion",
    f"WITH {_EXT} SELECT doc_id, regexp_matches(substr(file_path, 5), '(?i)(^|/)(bin|obj|node_modules)/') OR regexp_matches(substr(file_path, 5), '(?i)^src/api/') AS in_excluded, "
    r"regexp_matches(name, '(?i)^.*\.g\.cs$') OR regexp_matches(substr(lower(file_path), 5), '^docs/.*1.*\.md$') AS excluded FROM e",
)
def file_exclusion(spark, sf_dir):
    p, root = F.col("file_path"), F.col("workspace_root")
    return X.files(spark, sf_dir).select(
        "doc_id", P.excluded_directory(p, root, ["bin", "obj", "node_modules", "src/api"]).alias("in_excluded"), P.excluded_file(p, root, ["*.g.cs", "docs/*1*.md"]).alias("excluded")
    )


@query(
    "excluded_root",
    f"WITH {X.FILES} SELECT doc_id, nullif(regexp_extract(file_path, '(?i)^(/ws/(?:bin|src/api))/', 1), '') AS excluded_root FROM files",
)
def excluded_root(spark, sf_dir):
    return X.files(spark, sf_dir).select("doc_id", P.excluded_root(F.col("file_path"), F.col("workspace_root"), ["bin", "src/api", "none"]).alias("excluded_root"))


@query(
    "glob_classify",
    f"WITH {X.FILES} SELECT doc_id, regexp_matches(file_path, '(?i)^(.*/(doc|docs|documentation|api-docs|generated-docs)/.*)$') AS docs, "
    r"regexp_matches(file_path, '(?i)/(src|app|apps|client|frontend|ui|views|pages|components|wwwroot)/') AS app, regexp_matches(substr(file_path, 5), '(?i)^[^/]*/src1[^/]*/f[^/]\.ts$') AS narrow FROM files",
)
def glob_classify(spark, sf_dir):
    p, root = F.col("file_path"), F.col("workspace_root")
    return X.files(spark, sf_dir).select("doc_id", P.matches_glob(p, root, C.DOCUMENTATION_GLOBS).alias("docs"), P.matches_glob(p, root, C.APPLICATION_GLOBS).alias("app"), P.matches_glob(p, root, ["*/src1*/f?.ts"]).alias("narrow"))


@query("path_under_root", f"WITH {X.FILES} SELECT doc_id, starts_with(lower(file_path), '/ws/src/') AS under, starts_with(lower(file_path), lower('/ws/docs/' || source || '/')) AS own FROM files")
def path_under_root(spark, sf_dir):
    p = F.col("file_path")
    return X.files(spark, sf_dir).select("doc_id", P.is_under(p, F.lit("\\WS\\Src\\")).alias("under"), P.is_under(p, F.concat(F.lit("/ws/docs/"), "source")).alias("own"))


@query(
    "scan_files",
    f"WITH {_EXT} SELECT doc_id FROM e WHERE (ext IN ('.cs', '.csproj', '.json', '.yml') AND (ext <> '.yml' OR contains(file_path, '/.github/workflows/')) AND (ext <> '.json') OR "
    "ext IN ('.md', '.mdx', '.html', '.htm', '.txt', '.rst', '.adoc', '.asciidoc', '.ts', '.tsx', '.css', '.razor')) "
    "AND NOT regexp_matches(file_path, '(?i)/bin/') AND NOT regexp_matches(name, '[.]g[.]cs$') AND NOT (ext = '.cs' AND contains(lower(substr(content, 1, 4096)), '<auto-generated'))",
)
def scan_files(spark, sf_dir):
    return scan.scanned(X.files(spark, sf_dir)).select("doc_id")


# --- delta


@query("changed_files", f"WITH {X.STATES} SELECT file_path, fingerprint, chunk_count FROM changed")
def changed_files(spark, sf_dir):
    return delta.changed_files(X.current(spark, sf_dir), X.previous(spark, sf_dir)).select("file_path", "fingerprint", "chunk_count")


@query("deleted_files", f"WITH {X.STATES} SELECT file_path, chunk_count FROM deleted")
def deleted_files(spark, sf_dir):
    return delta.deleted_files(X.current(spark, sf_dir), X.previous(spark, sf_dir)).select("file_path", "chunk_count")


@query("preserved_files", f"WITH {X.STATES} SELECT file_path, fingerprint FROM prev WHERE k NOT IN (SELECT k FROM changed) AND k NOT IN (SELECT k FROM deleted)")
def preserved_files(spark, sf_dir):
    cur, prev = X.current(spark, sf_dir), X.previous(spark, sf_dir)
    return delta.preserved_files(prev, delta.changed_files(cur, prev), delta.deleted_files(cur, prev)).select("file_path", "fingerprint")


@query("unchanged_count", f"WITH {X.STATES} SELECT count(*) AS unchanged FROM cur WHERE k NOT IN (SELECT k FROM changed)")
def unchanged_count(spark, sf_dir):
    cur = X.current(spark, sf_dir)
    return delta.unchanged_count(cur, delta.changed_files(cur, X.previous(spark, sf_dir)))


@query(
    "chunk_count_backfill",
    f"WITH {X.STATES} SELECT cur.file_path, CAST(coalesce(c.chunk_count + 100, p.chunk_count, cur.chunk_count) AS INTEGER) AS chunk_count FROM cur LEFT JOIN changed c USING (k) LEFT JOIN prev p USING (k)",
)
def chunk_count_backfill(spark, sf_dir):
    cur, prev = X.current(spark, sf_dir), X.previous(spark, sf_dir)
    counted = delta.changed_files(cur, prev).select("path_key", (F.col("chunk_count") + 100).alias("chunk_count"))
    return delta.backfilled(cur, counted, prev).select("file_path", "chunk_count")


@query(
    "scoped_state_merge",
    f"WITH {X.STATES} SELECT file_path, chunk_count FROM prev WHERE NOT starts_with(k, '/ws/docs/') AND k NOT IN (SELECT k FROM cur) UNION ALL SELECT file_path, chunk_count FROM cur",
)
def scoped_state_merge(spark, sf_dir):
    merged = delta.merged_state(X.previous(spark, sf_dir), X.current(spark, sf_dir), P.is_under(F.col("file_path"), F.lit("/ws/docs")))
    return merged.select("file_path", "chunk_count")


@query(
    "dry_run_estimates",
    f"WITH {X.STATES}, a AS (SELECT k, file_path FROM cur UNION ALL SELECT k, file_path FROM deleted) SELECT a.file_path, c.k IS NOT NULL AS changed, d.k IS NOT NULL AS deleted, "
    "coalesce(p.chunk_count, 0) AS current_chunks, CASE WHEN c.k IS NOT NULL THEN c.chunk_count ELSE 0 END AS estimated_chunks, "
    "CASE WHEN c.k IS NOT NULL OR d.k IS NOT NULL THEN coalesce(p.chunk_count, 0) ELSE 0 END AS estimated_deletes FROM a LEFT JOIN prev p USING (k) LEFT JOIN changed c USING (k) LEFT JOIN deleted d USING (k)",
)
def dry_run_estimates(spark, sf_dir):
    cur, prev = X.current(spark, sf_dir), X.previous(spark, sf_dir)
    return delta.dry_run(cur, prev, delta.keyed(cur).select("path_key", "chunk_count"))


@query(
    "checkpoint_state",
    f"WITH {X.STATES} SELECT file_path, chunk_count FROM prev WHERE k NOT IN (SELECT k FROM changed) AND k NOT IN (SELECT k FROM deleted) "
    "UNION ALL SELECT file_path, CAST(7 AS INTEGER) FROM changed WHERE chunk_count > 1",
)
def checkpoint_state(spark, sf_dir):
    cur, prev = X.current(spark, sf_dir), X.previous(spark, sf_dir)
    changed = delta.changed_files(cur, prev)
    done = changed.filter("chunk_count > 1").select("path_key", F.lit(7).alias("chunk_count"))
    return delta.checkpoint_state(prev, cur, changed, delta.deleted_files(cur, prev), done).select("file_path", "chunk_count")


@query("resume_files", f"WITH {X.STATES} SELECT file_path FROM changed WHERE chunk_count <= 1")
def resume_files(spark, sf_dir):
    changed = delta.changed_files(X.current(spark, sf_dir), X.previous(spark, sf_dir))
    return delta.resumed(changed, changed.filter("chunk_count > 1").drop("path_key")).select("file_path")


@query("state_pages", f"WITH {X.STATES}, n AS (SELECT file_path, k, regexp_replace(k, '[^/]*$', '') AS d FROM cur) SELECT file_path, CAST((row_number() OVER (ORDER BY d, k, file_path) - 1) // 512 AS INTEGER) AS page FROM n")
def state_pages(spark, sf_dir):
    return delta.state_pages(X.current(spark, sf_dir)).select("file_path", "page")


@query("chunks_per_file", _SPLIT + "SELECT lower(file_path) AS path_key, CAST(count(*) AS INTEGER) AS chunk_count FROM parts JOIN files USING (doc_id) GROUP BY 1")
def chunks_per_file(spark, sf_dir):
    return delta.chunks_per_file(chunking.text_chunks(X.files(spark, sf_dir)))


@query("index_status", f"WITH {X.STATES} SELECT count(*) AS files, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM cur")
def index_status(spark, sf_dir):
    return delta.index_summary(X.current(spark, sf_dir)).select("files", "chunks")


@query(
    "change_overlay",
    "WITH c AS (SELECT 'f' || user_id AS path, CASE WHEN event_type IN (SELECT min(event_type) FROM events) THEN 'delete' ELSE 'change' END AS op, event_id FROM events) "
    "SELECT path, arg_max(op, event_id) AS op FROM c GROUP BY path",
)
def change_overlay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("m"))
    gone = e.join(F.broadcast(first), e["event_type"] == first["m"], "left").select(F.concat(F.lit("f"), "user_id").alias("path"), F.when(F.col("m").isNotNull(), "delete").otherwise("change").alias("op"), F.col("event_id").alias("seq"))
    return delta.overlay(gone)


_PLAN = f"""WITH {X.STATES},
ch AS (SELECT lower(file_path) AS k, CASE WHEN size > 2000 THEN 'delete' ELSE 'change' END AS op FROM files WHERE source <> 'src5'),
known AS (SELECT ch.* FROM ch WHERE k IN (SELECT k FROM cur) OR k IN (SELECT k FROM prev))
SELECT cur.file_path, 'changed' AS what FROM cur JOIN known USING (k) WHERE op = 'change'
UNION ALL SELECT prev.file_path, 'deleted' FROM prev JOIN known USING (k) WHERE k NOT IN (SELECT k FROM cur)"""


@query("planned_changes", _PLAN)
def planned_changes(spark, sf_dir):
    f = X.files(spark, sf_dir).filter("source <> 'src5'")
    changes = f.select(F.upper("file_path").alias("path"), F.when(F.col("size") > 2000, "delete").otherwise("change").alias("op"), F.col("doc_id").alias("seq"))
    changed, gone = delta.planned(changes, True, X.current(spark, sf_dir), X.previous(spark, sf_dir))
    return changed.select("file_path", F.lit("changed").alias("what")).unionByName(gone.select("file_path", F.lit("deleted").alias("what")))


# --- embedding and store


@query("embedding_dedup", "SELECT sha256(substr(coalesce(text, ''), 1, 8000)) AS content_hash, count(*) AS uses, min(length(substr(coalesce(text, ''), 1, 8000))) AS chars FROM documents GROUP BY 1")
def embedding_dedup(spark, sf_dir):
    once = embedding.embedding_inputs(X.files(spark, sf_dir))
    return once.select("content_hash", "uses", F.length("content").cast("long").alias("chars"))


@query("embed_chunks")
def embed_chunks(spark, sf_dir):
    chunks = chunking.documentation_chunks(X.files(spark, sf_dir).filter(C.accepts(F.col("file_path"))["documentation"]).select("workspace_root", "file_path", "content"))
    return embedding.embedded(chunks, embedding.HashingProvider()).select("id", "embedding", "embedding_error")


_NEW = "SELECT vec_id, label + 100 AS label FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label = 9"


@query("upsert_points", f"WITH n AS ({_NEW}) SELECT vec_id AS point_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT vec_id, CAST(label AS BIGINT) FROM n")
def upsert_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").cast("long").alias("label"))
    new = e.filter("label < 3").withColumn("label", F.col("label") + 100).unionByName(e.filter("label = 9").withColumn("point_id", F.col("point_id") + 1_000_000))
    return store.upserted(e, new)


def _stored(spark, sf_dir) -> tuple[store.VectorStore, DataFrame]:
    """All points in a store, and their frame."""
    v = X.vectors(spark, sf_dir).select("point_id", "workspace_id", "file_path", "content_type", "start_line", "embedding")
    s = store.VectorStore(spark, shared.folder(spark, "store"))
    s.promote("points", s.build("points", v))
    return s, v


@query(
    "delta_upsert",
    f"""WITH {X.VECTORS}
SELECT point_id, CASE WHEN content_type = 'markup' THEN start_line + 1000 ELSE start_line END AS start_line FROM vectors
UNION ALL SELECT point_id + 1000000, start_line FROM vectors WHERE content_type = 'documentation'""",
)
def delta_upsert(spark, sf_dir):
    s, v = _stored(spark, sf_dir)
    again = v.filter("content_type = 'markup'").withColumn("start_line", (F.col("start_line") + 1000).cast("int"))
    s.upsert("points", again.unionByName(v.filter("content_type = 'documentation'").withColumn("point_id", F.col("point_id") + 1_000_000)))
    return s.read("points").select("point_id", "start_line")


@query(
    "compacted_points",
    f"""WITH {X.VECTORS}, gone AS (SELECT DISTINCT file_path FROM vectors WHERE content_type = 'markup')
SELECT point_id, file_path, workspace_id FROM vectors
WHERE NOT (workspace_id = 'w1' AND file_path IN (SELECT file_path FROM gone)) AND NOT (workspace_id = 'w2' AND file_path = '/ws/src/f3.cs')""",
)
def compacted_points(spark, sf_dir):
    s, v = _stored(spark, sf_dir)
    s.delete_files("points", "w1", v.filter("content_type = 'markup'").select(F.upper("file_path").alias("file_path")))
    s.delete_directories("points", "w2", ["/WS/src/f3.cs", "/ws/sr"])
    s.compact("points")
    return s.read("points").select("point_id", "file_path", "workspace_id")


@query(
    "points_below",
    f"WITH {X.FILES} SELECT doc_id, file_path FROM files WHERE starts_with(file_path, '/ws/src/') OR starts_with(file_path, '/ws/docs/src1/')",
)
def points_below(spark, sf_dir):
    """Rows below two directories, by ranges of the sorted path that the scan of the stored table takes."""
    s = store.VectorStore(spark, shared.folder(spark, "store"))
    s.promote("files", s.build("files", X.files(spark, sf_dir).select("doc_id", "file_path", "size")))
    return s.read_below("files", "/WS/src").unionByName(s.read_below("files", "/ws/docs/src1")).select("doc_id", "file_path")


@query("delete_by_files", f"WITH {X.VECTORS} SELECT point_id FROM vectors WHERE NOT (workspace_id = 'w1' AND file_path IN (SELECT file_path FROM vectors WHERE content_type = 'markup'))")
def delete_by_files(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return store.without_files(v, "w1", v.filter("content_type = 'markup'").select(F.upper("file_path").alias("file_path"))).select("point_id")


@query("delete_by_directories", f"WITH {X.FILES} SELECT doc_id FROM files WHERE NOT (starts_with(file_path, '/ws/docs/') OR starts_with(file_path, '/ws/src/api/'))")
def delete_by_directories(spark, sf_dir):
    f = X.files(spark, sf_dir).withColumn("workspace_id", F.lit("w"))
    return store.without_directories(f, "w", ["/WS/docs/", "/ws/src/api"]).select("doc_id")


@query(
    "remap_points",
    f"WITH {X.FILES}, r AS (SELECT doc_id, CASE WHEN starts_with(file_path, '/ws/src/') THEN '/code' || substr(file_path, 8) ELSE '/moved' || substr(file_path, 4) END AS file_path FROM files) "
    "SELECT doc_id, file_path, '/moved' AS workspace_root, substr(sha256('/moved'), 1, 32) AS workspace_id FROM r",
)
def remap_points(spark, sf_dir):
    f = X.files(spark, sf_dir).withColumns({"repository_root": F.lit("/ws"), "relative_path": P.relative(F.col("file_path"), F.lit("/ws")), "workspace_id": F.lit("old")})
    return transfer.remapped_points(f, {"/ws": "/moved/", "/WS/src": "/code"}).select("doc_id", "file_path", "workspace_root", "workspace_id")


@query(
    "recovery_summary",
    f"WITH {X.VECTORS}, f AS (SELECT lower(file_path) AS k, count(*) AS n FROM vectors GROUP BY 1), t AS (SELECT DISTINCT lower(file_path) AS k FROM vectors WHERE content_type = 'code') "
    "SELECT CAST(sum(n) AS BIGINT) AS points_scanned, count(t.k) AS files, count(*) - count(t.k) AS missing FROM f LEFT JOIN t USING (k)",
)
def recovery_summary(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return transfer.recovery_summary(v, v.filter("content_type = 'code'").select("file_path").distinct())


# --- lookup


def _context_chunks(spark, sf_dir):
    """Conversations as stored chunks of one file each, four lines a turn and overlapping by one."""
    c = table(spark, sf_dir, "conversations")
    text = F.coalesce(F.regexp_replace("text", r"[\r\n]+", " "), F.lit(""))
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{k} "), text) for k in range(4)])
    return c.select(F.concat(F.lit("/ws/c"), "conv_id").alias("file_path"), (F.col("turn") * 3 + 1).cast("int").alias("start_line"), (F.col("turn") * 3 + 4).cast("int").alias("end_line"), body.alias("content"), F.col("role").alias("symbol_name"), F.lit("Turn").alias("symbol_kind"))


@query(
    "code_context",
    r"WITH c AS (SELECT conv_id, turn, coalesce(regexp_replace(text, '[\r\n]+', ' ', 'g'), '') AS t FROM conversations WHERE conv_id = 1), "
    "l AS (SELECT turn * 3 + 1 + k AS line, turn * 3 + 1 AS s, k || ' ' || t AS x FROM (SELECT *, unnest(range(0, 4)) AS k FROM c)) "
    "SELECT '/ws/c1' AS file_path, CAST(line AS INTEGER) AS line, lpad(CAST(line AS VARCHAR), 5, ' ') || ': ' || arg_max(x, s) AS text FROM l WHERE line BETWEEN 3 AND 9 GROUP BY line",
)
def code_context(spark, sf_dir):
    return chunking.chunk_context(_context_chunks(spark, sf_dir), "/WS/C1", 5, 2, 4)


@query("symbol_details", "SELECT '/ws/c1' AS file_path, role AS symbol_name, CAST(turn * 3 + 1 AS INTEGER) AS start_line FROM conversations WHERE conv_id = 1 AND role = 'assistant' ORDER BY turn LIMIT 1")
def symbol_details(spark, sf_dir):
    return chunking.symbol_details(_context_chunks(spark, sf_dir), "/ws/c1", "Assistant").select("file_path", "symbol_name", "start_line")


@query(
    "numbered_lines",
    r"SELECT doc_id, i AS line, lpad(CAST(i AS VARCHAR), 5, ' ') || ': ' || ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents))",
)
def numbered_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("k", "x"))
    n = (F.col("k") + 1).cast("long")
    return d.select("doc_id", n.alias("line"), T.numbered_line(n, F.col("x")).alias("text"))


# --- catalog


@query("registry_latest", f"WITH {X.REGISTRY} SELECT workspace_root, custkey, status FROM latest")
def registry_latest(spark, sf_dir):
    return catalog.latest_by_root(catalog.registry_rows(X.registry(spark, sf_dir))).select("workspace_root", "custkey", "status")


@query(
    "scope_longest_prefix",
    f"WITH {X.REGISTRY}, ready AS (SELECT * FROM latest WHERE status = 'completed'), p AS (SELECT s_suppkey, '/WS/n' || s_nationkey || '/c' || s_suppkey || '/src/a.cs' AS path FROM supplier), "
    "j AS (SELECT s_suppkey, path, workspace_root FROM p LEFT JOIN ready ON starts_with(lower(path), lower(workspace_root) || '/')) "
    "SELECT path, arg_max(workspace_root, length(workspace_root)) AS workspace_root FROM j GROUP BY path",
)
def scope_longest_prefix(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    paths = s.select(F.concat(F.lit("/WS/n"), "s_nationkey", F.lit("/c"), "s_suppkey", F.lit("/src/a.cs")).alias("path"))
    ready = catalog.searchable(catalog.latest_by_root(catalog.registry_rows(X.registry(spark, sf_dir))))
    return catalog.deepest_workspace(paths, ready).select("path", "workspace_root")


@query(
    "group_overlay",
    f"WITH {X.GROUPS} SELECT lower(name) AS name, source FROM grp QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY CASE source WHEN 'configured' THEN 0 WHEN 'local' THEN 1 ELSE 2 END, name) = 1",
)
def group_overlay(spark, sf_dir):
    return catalog.overlaid_groups(X.groups(spark, sf_dir)).select(F.lower("name").alias("name"), "source")


@query(
    "group_expand",
    f"WITH {X.REGISTRY}, {X.GROUPS}, g AS (SELECT DISTINCT name, unnest(['/ws/n' || nk, '/ws/n' || rk]) AS k FROM grp WHERE source = 'shared') SELECT DISTINCT name, workspace_root FROM g JOIN latest ON lower(workspace_root) = k",
)
def group_expand(spark, sf_dir):
    known = catalog.latest_by_root(catalog.registry_rows(X.registry(spark, sf_dir)))
    return catalog.group_members(X.groups(spark, sf_dir).filter("source = 'shared'"), known).select("name", "workspace_root").distinct()


@query("alias_match", f"WITH {X.REGISTRY} SELECT custkey FROM reg WHERE list_contains(list_transform(aliases, lambda a: lower(a)), 'building')")
def alias_match(spark, sf_dir):
    return catalog.aliased(X.registry(spark, sf_dir), " Building ").select("custkey")


# --- evaluation

_EVAL = f"""WITH {X.VECTORS.replace('documents ON vec_id = doc_id', 'documents ON vec_id = doc_id')},
a AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, point_id, content_type, file_path, label, round(list_cosine_similarity(embedding, a.v), 6) AS score FROM a, vectors),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s),
best AS (SELECT query_id, min(CASE WHEN point_id <> query_id AND (content_type = {X._pick_sql(X.TYPES, 'label')} AND contains(file_path, 'src/f1') OR contains(file_path, 'src/f2')) THEN rank END) AS best_rank
  FROM r WHERE rank <= 10 GROUP BY query_id)
"""


def _eval_ranks(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").withColumn("label", F.col("label").cast("long"))
    hits = search.batched_topk(v, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)
    results = hits.filter("point_id <> query_id").join(v.drop("embedding"), "point_id")
    blank = {f: F.lit(None).cast("string").alias(f) for f in evaluation._FIELDS}
    want = lambda **k: F.struct(*[(k[f].alias(f) if f in k else blank[f]) for f in evaluation._FIELDS])
    asked = e.select(
        F.col("vec_id").alias("query_id"),
        F.array(want(contentType=X._pick(X.TYPES, "label"), fileContains=F.lit("src\\F1")), want(file=F.lit("src/f2"), symbol=F.lit(" "))).alias("expected"),
    )
    return evaluation.best_ranks(asked, results)


@query("eval_ranks", _EVAL + "SELECT query_id, CAST(best_rank AS INTEGER) AS best_rank FROM best")
def eval_ranks(spark, sf_dir):
    return _eval_ranks(spark, sf_dir)


@query(
    "eval_metrics",
    _EVAL + "SELECT count(*) AS queries, count(best_rank) AS passed, round(count(best_rank) / CAST(count(*) AS DOUBLE), 6) AS pass_rate, round(count(*) FILTER (best_rank <= 1) / CAST(count(*) AS DOUBLE), 6) AS hit_rate_at_1, "
    "round(count(*) FILTER (best_rank <= 5) / CAST(count(*) AS DOUBLE), 6) AS hit_rate_at_5, round(avg(coalesce(1.0 / best_rank, 0)), 6) AS mrr, round(coalesce(avg(best_rank), 0), 6) AS average_best_rank FROM best",
)
def eval_metrics(spark, sf_dir):
    m = evaluation.metrics(_eval_ranks(spark, sf_dir))
    return m.select("queries", "passed", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


# --- solutions


@query(
    "project_closure",
    "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey * 7 AS dst FROM lineitem), r AS (SELECT p_partkey AS node FROM part WHERE p_size = 1 UNION SELECT dst FROM r JOIN e ON r.node = e.src) SELECT node FROM r",
)
def project_closure(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 7).alias("dst")).distinct()
    return solution.closure(table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("node")), edges)


# --- triggers


def _requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("event_type"))
    kinds = e.select("event_type").distinct().withColumn("kind", kind)
    some = lambda on, v: F.when(on, v)
    return e.join(F.broadcast(kinds), "event_type").select(
        "event_id", "ts", some(F.col("kind") == 1, F.lit("/ws")).alias("workspace_path"), some(F.col("kind") == 2, F.lit("g")).alias("workspace_group"),
        some(F.col("kind") <= 3, F.lit("https://r.example/x")).alias("repository_url"), some(F.col("value") > 50, F.lit("disk full")).alias("error"),
    )


@query(
    "trigger_status",
    "WITH k AS (SELECT event_id, value, dense_rank() OVER (ORDER BY event_type) AS kind FROM events) SELECT event_id, CASE WHEN kind <= 2 AND value > 50 THEN 'Failed' WHEN kind <= 2 THEN 'Completed' WHEN kind = 3 THEN 'Queued' ELSE 'Rejected' END AS status FROM k",
)
def trigger_status(spark, sf_dir):
    r = _requests(spark, sf_dir)
    return r.select("event_id", triggers.trigger_status(*[F.col(c) for c in ("workspace_path", "workspace_group", "repository_url", "error")]).alias("status"))


@query("recent_events", "SELECT event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS position FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_events(spark, sf_dir):
    return triggers.recent(table(spark, sf_dir, "events").select("event_id", "event_type", "ts")).select("event_id", "event_type", "position")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return triggers.windowed_counts(table(spark, sf_dir, "events"))


@query(
    "webhook_changes",
    "WITH g AS (SELECT conv_id, list_sort(list_distinct(list(role || '/' || turn) FILTER (role <> 'system'))) AS c, list_sort(list_distinct(list('gone/' || turn) FILTER (turn > 2))) AS d FROM conversations GROUP BY conv_id) "
    "SELECT conv_id, 'main' AS branch, 's' || conv_id AS commit_sha, coalesce(array_to_string(c, ','), '') AS changed, coalesce(array_to_string(d, ','), '') AS deleted FROM g",
)
def webhook_changes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    commit = F.struct(
        F.when(F.col("role") == "user", F.array(F.concat_ws("/", "role", "turn"))).alias("added"),
        F.when(F.col("role") == "assistant", F.array(F.concat_ws("/", "role", "turn"))).alias("modified"),
        F.when(F.col("turn") > 2, F.array(F.concat(F.lit("gone/"), "turn"))).alias("removed"),
    )
    body = c.groupBy("conv_id").agg(F.collect_list(commit).alias("commits")).select(
        "conv_id", F.to_json(F.struct(F.lit("refs/heads/main").alias("ref"), F.concat(F.lit("s"), "conv_id").alias("after"), "commits", F.get("commits", F.lit(0)).alias("head_commit"))).alias("body")
    )
    hook = body.select("conv_id", webhook(F.col("body")).alias("h"))
    return hook.select("conv_id", "h.branch", "h.commit_sha", F.array_join("h.changed_files", ",").alias("changed"), F.array_join("h.deleted_files", ",").alias("deleted"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over all workspaces, re-ranked, boosted and packed."""
    return search.search(X.vectors(spark, sf_dir), _ask(spark, sf_dir, limit=10, hybrid=True, mode="docs_first"))


from siltstone import index_queries  # noqa: E402,F401  registers its own
