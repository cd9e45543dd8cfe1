"""The corpus tables in the roles of files, states, vectors and catalogs, in Spark and in SQL.

Documents are the files of one workspace; their id only gives a path its extension and directory.
The earlier state holds all languages but one, the present one all sources but one, and long texts
have another fingerprint in the earlier state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import keys as K
from siltstone.functions import text as T
from siltstone.sources.tables import table

ROOT = "/ws"
EXTENSIONS = (".md", ".txt", ".cs", ".ts", ".tsx", ".html", ".yml", ".csproj", ".css", ".json", ".razor", ".rst", ".vue", "", ".g.cs")
DIRECTORIES = ("docs", "src", "tests", "frontend", "lib", "ui/views", "bin", "src/api/Test", ".github/workflows")
TYPES = ("code", "documentation", "markup", "project_metadata")
PROFILES = ("code", "docs", "frontend", "metadata", "tests")
LANGUAGES = ("csharp", "markdown", "html", "typescript", "xml", "css", "razor")


def _pick(values: tuple[str, ...], index: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(index) % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], index: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{index} % {len(values)} + 1]"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit(ROOT + "/"), _pick(DIRECTORIES, "doc_id"), F.lit("/"), F.col("source"), F.lit("/f"), F.col("doc_id"), _pick(EXTENSIONS, "doc_id"))
    return d.select(
        "doc_id",
        F.lit(ROOT).alias("workspace_root"),
        path.alias("file_path"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.col("n_chars").alias("size"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("doc_id") * 1_000_000).alias("last_write_time_utc"),
        "source",
        "lang",
    )


FILES = f"""files AS (SELECT doc_id, '{ROOT}' AS workspace_root,
  '{ROOT}/' || {_pick_sql(DIRECTORIES, 'doc_id')} || '/' || source || '/f' || doc_id || {_pick_sql(EXTENSIONS, 'doc_id')} AS file_path,
  coalesce(text, '') AS content, n_chars AS size, source, lang FROM documents)"""


def _state(f: DataFrame, old: bool) -> DataFrame:
    print_ = K.content_fingerprint(F.col("content"))
    if old:
        print_ = F.when(F.col("size") > 3000, "sha256:OLD").otherwise(print_)
    return f.select("file_path", print_.alias("fingerprint"), "size", "last_write_time_utc", F.ceil(F.col("size") / 1500).cast("int").alias("chunk_count"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(files(spark, sf_dir).filter("source <> 'src3'"), False)


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier state spells its paths in upper case, as another system might."""
    return _state(files(spark, sf_dir).filter("lang <> 'es'"), True).withColumn("file_path", F.upper("file_path"))


STATES = f"""{FILES},
cur AS (SELECT lower(file_path) AS k, file_path, 'sha256:' || upper(sha256(content)) AS fingerprint, CAST(ceil(size / 1500.0) AS INTEGER) AS chunk_count
  FROM files WHERE source <> 'src3'),
prev AS (SELECT lower(file_path) AS k, upper(file_path) AS file_path, CASE WHEN size > 3000 THEN 'sha256:OLD' ELSE 'sha256:' || upper(sha256(content)) END
  AS fingerprint, CAST(ceil(size / 1500.0) AS INTEGER) AS chunk_count FROM files WHERE lang <> 'es'),
changed AS (SELECT cur.* FROM cur LEFT JOIN prev USING (k) WHERE prev.k IS NULL OR prev.fingerprint <> cur.fingerprint),
deleted AS (SELECT prev.* FROM prev ANTI JOIN cur USING (k))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("long"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("content"))
    line = F.col("vec_id") % 8 * 5 + 1
    return e.join(d, "vec_id", "left").withColumn("content", F.coalesce("content", F.lit(""))).select(
        F.col("vec_id").alias("point_id"),
        "embedding",
        F.concat(F.lit("w"), F.col("vec_id") % 3).alias("workspace_id"),
        F.lit(ROOT).alias("workspace_root"),
        F.concat(F.lit(ROOT + "/src/f"), F.floor(F.col("vec_id") / 16), F.lit(".cs")).alias("file_path"),
        F.concat(F.lit("s"), F.floor(F.col("vec_id") / 4)).alias("symbol_name"),
        F.lit("Member").alias("symbol_kind"),
        line.cast("int").alias("start_line"),
        (line + 5).cast("int").alias("end_line"),
        _pick(TYPES, "label").alias("content_type"),
        _pick(PROFILES, "label").alias("index_profile"),
        _pick(LANGUAGES, "label").alias("language"),
        T.preview(F.col("content")).alias("preview"),
        "content",
    )


VECTORS = f"""vectors AS (SELECT vec_id AS point_id, embedding::DOUBLE[] AS embedding, 'w' || (vec_id % 3) AS workspace_id,
  '{ROOT}/src/f' || (vec_id // 16) || '.cs' AS file_path, 's' || (vec_id // 4) AS symbol_name,
  CAST(vec_id % 8 * 5 + 1 AS INTEGER) AS start_line, CAST(vec_id % 8 * 5 + 6 AS INTEGER) AS end_line,
  {_pick_sql(TYPES, 'label')} AS content_type, {_pick_sql(PROFILES, 'label')} AS index_profile, {_pick_sql(LANGUAGES, 'label')} AS language,
  coalesce(text, '') AS content, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE coalesce(text, '') END AS preview
  FROM embeddings LEFT JOIN documents ON vec_id = doc_id),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
words AS (SELECT list_filter(list_transform(string_split(text, ' '), lambda t: trim(t)), lambda t: t <> '') AS ts FROM benchmark ORDER BY item_id LIMIT 1),
sem AS (SELECT vectors.*, round(list_cosine_similarity(embedding, v), 6) AS score FROM vectors, q),
kw AS (SELECT sem.* EXCLUDE (score), score AS cos, len(list_filter(ts, lambda t: contains(lower(content), lower(t)))) / CAST(len(ts) AS DOUBLE) AS share
  FROM sem, words)"""


def query_vector(spark: SparkSession, sf_dir: str) -> tuple[float, ...]:
    return tuple(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def query_text(spark: SparkSession, sf_dir: str) -> str:
    return table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()[0]


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as indexed workspaces, nested four deep; nations are their groups."""
    c = table(spark, sf_dir, "customer")
    root = F.concat_ws("/", F.lit("/ws"), F.concat(F.lit("n"), "c_nationkey"), F.when(F.col("c_acctbal") > 1000, F.concat(F.lit("c"), "c_custkey")))
    return c.select(
        root.alias("workspace_root"),
        K.workspace_id(root).alias("workspace_id"),
        K.collection_name(F.lit("Siltstone Test"), K.workspace_id(root)).alias("collection_name"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey")).alias("last_indexed_utc"),
        F.array("c_mktsegment", F.col("c_name")).alias("aliases"),
        F.when(F.col("c_acctbal") < 0, "indexing").when(F.col("c_acctbal") < 500, "").otherwise("completed").alias("status"),
        F.col("c_custkey").alias("custkey"),
    )


REGISTRY = """reg0 AS (SELECT c_custkey AS custkey, '/ws/n' || c_nationkey || CASE WHEN c_acctbal > 1000 THEN '/c' || c_custkey ELSE '' END AS workspace_root,
  [c_mktsegment, c_name] AS aliases, CASE WHEN c_acctbal < 0 THEN 'indexing' ELSE 'completed' END AS status FROM customer),
reg AS (SELECT *, substr(sha256(workspace_root), 1, 32) AS workspace_id, 'siltstone-test-' || substr(sha256(workspace_root), 1, 32) AS collection_name FROM reg0),
latest AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY lower(workspace_root) ORDER BY custkey DESC) = 1)"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and suppliers as groups from three sources, under clashing names."""
    n = table(spark, sf_dir, "nation")
    roots = F.array(F.concat(F.lit("/ws/n"), "n_nationkey"), F.concat(F.lit("/WS/N"), "n_regionkey"))
    make = lambda name, source: n.select(name.alias("name"), F.lit(source).alias("source"), roots.alias("roots"), F.array(F.lit("bin")).alias("exclude_directories"), F.lit(source == "configured").alias("is_read_only"))
    return make(F.col("n_name"), "shared").unionByName(make(F.upper(F.concat(F.lit("g"), F.col("n_regionkey"))), "local")).unionByName(
        make(F.concat(F.lit("g"), F.floor(F.col("n_nationkey") / 8)), "configured").filter("roots[0] IS NOT NULL")
    )


GROUPS = """grp AS (SELECT n_name AS name, 'shared' AS source, n_nationkey AS nk, n_regionkey AS rk FROM nation
  UNION ALL SELECT upper('g' || n_regionkey), 'local', n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 'g' || (n_nationkey // 8), 'configured', n_nationkey, n_regionkey FROM nation)"""
