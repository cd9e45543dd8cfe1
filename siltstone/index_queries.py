"""Queries of targets, solutions, states, catalogs and moves, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schemas as S
from siltstone.functions import keys as K
from siltstone.functions import paths as P
from siltstone.operators import catalog, chunking, delta, scan, solution, store, transfer
from siltstone.plans import fixtures as X
from siltstone.queries import query
from siltstone.sources.changes import with_identity
from siltstone.sources.tables import table
from siltstone.streaming import triggers

# --- targets


@query(
    "target_scan",
    f"WITH {X.FILES} SELECT doc_id FROM files WHERE starts_with(file_path, '/ws/docs/') OR starts_with(file_path, '/ws/src/') "
    "OR doc_id = (SELECT min(doc_id) FROM files WHERE starts_with(file_path, '/ws/lib/'))",
)
def target_scan(spark, sf_dir):
    f = X.files(spark, sf_dir)
    one = f.filter(P.is_under(F.col("file_path"), F.lit("/ws/lib"))).orderBy("doc_id").first().file_path
    return scan.targets(f, ["/WS/docs", "/ws/src/"], [one]).select("doc_id")


@query(
    "single_file_target",
    f"WITH {X.FILES} SELECT file_path, true AS scanned FROM files WHERE doc_id = (SELECT min(doc_id) FROM files WHERE starts_with(file_path, '/ws/docs/') AND file_path LIKE '%.md') "
    "UNION ALL SELECT file_path, false FROM files WHERE doc_id = (SELECT min(doc_id) FROM files WHERE starts_with(file_path, '/ws/bin/'))",
)
def single_file_target(spark, sf_dir):
    f = X.files(spark, sf_dir)
    first = lambda d: f.filter(d).orderBy("doc_id").first().file_path
    named = first(F.startswith("file_path", F.lit("/ws/docs/")) & F.endswith("file_path", F.lit(".md"))), first(F.startswith("file_path", F.lit("/ws/bin/")))
    taken = [scan.target_files(f, n.upper(), ["bin"]) for n in named]
    return taken[0].unionByName(taken[1])


def _projects(spark, sf_dir) -> DataFrame:
    """Suppliers as projects that refer to the next one in the next nation, nations as solutions that name theirs."""
    s = table(spark, sf_dir, "supplier")
    body = F.concat(F.lit('<Project><PropertyGroup/><projectReference Include="..\\n'), (F.col("s_nationkey") + 1) % 25, F.lit("\\s"), F.col("s_suppkey") + 1, F.lit('.csproj" /></Project>'))
    broken = F.when(F.col("s_suppkey") % 7 == 0, F.regexp_replace(body, "</Project>", "")).otherwise(body)
    place = F.concat(F.lit("/w/n"), "s_nationkey", F.lit("/s"), "s_suppkey", F.lit(".csproj"))
    projects = s.select(place.alias("file_path"), broken.alias("content"))
    line = F.concat(F.lit('Project("{X}") = "P", "s'), "s_suppkey", F.lit('.csproj", "{Y}"'))
    named = s.groupBy("s_nationkey").agg(F.concat_ws("\n", F.collect_list(line)).alias("content"))
    solutions = named.select(F.concat(F.lit("/w/n"), "s_nationkey", F.lit("/all.sln")).alias("file_path"), F.concat("content", F.lit('\nProject("{X}") = "None", "none.csproj", "{Y}"')).alias("content"))
    return projects.unionByName(solutions)


_PLACE = "'/w/n' || {0}.s_nationkey || '/s' || {0}.s_suppkey || '.csproj'"
_REFERS = f"""e AS (SELECT {_PLACE.format('a')} AS src, {_PLACE.format('b')} AS dst FROM supplier a JOIN supplier b
  ON b.s_suppkey = a.s_suppkey + 1 AND b.s_nationkey = (a.s_nationkey + 1) % 25 WHERE a.s_suppkey % 7 <> 0)"""


@query("solution_projects", f"SELECT '/w/n' || s_nationkey || '/all.sln' AS file_path, {_PLACE.format('supplier')} AS project FROM supplier")
def solution_projects(spark, sf_dir):
    return solution.solution_projects(_projects(spark, sf_dir))


@query("project_references", f"WITH {_REFERS} SELECT src AS file_path, dst AS project FROM e")
def project_references(spark, sf_dir):
    return solution.project_references(_projects(spark, sf_dir))


@query(
    "shared_metadata",
    "WITH m AS (SELECT '/w/n' || n_nationkey || '/Directory.Build.props' AS file_path, n_nationkey AS k FROM nation UNION ALL SELECT '/other/' || r_regionkey || '/global.json', 99 FROM region "
    "UNION ALL SELECT '/w/NuGet.config', 0 FROM region) SELECT DISTINCT file_path FROM m WHERE k < 6",
)
def shared_metadata(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    files = n.select(F.concat(F.lit("/w/n"), "n_nationkey", F.lit("/Directory.Build.props")).alias("file_path"))
    files = files.unionByName(r.select(F.concat(F.lit("/other/"), "r_regionkey", F.lit("/global.json")).alias("file_path"))).unionByName(r.select(F.lit("/w/NuGet.config").alias("file_path")))
    directories = n.filter("n_nationkey < 6").select(F.concat(F.lit("/w/N"), "n_nationkey", F.lit("/deep/down")).alias("directory"))
    return solution.shared_metadata(directories, files, "/W")


@query(
    "solution_scope",
    f"WITH RECURSIVE {_REFERS}, r AS (SELECT {_PLACE.format('supplier')} AS node FROM supplier WHERE s_nationkey = 3 UNION SELECT dst FROM r JOIN e ON node = src), "
    "d AS (SELECT DISTINCT regexp_replace(node, '/[^/]*$', '') AS d FROM r), "
    f"f AS (SELECT {_PLACE.format('supplier')} AS file_path FROM supplier UNION SELECT '/w/n' || s_nationkey || '/all.sln' FROM supplier) "
    "SELECT file_path FROM f WHERE regexp_replace(file_path, '/[^/]*$', '') IN (SELECT d FROM d) OR file_path = '/w/n3/all.sln'",
)
def solution_scope(spark, sf_dir):
    return solution.solution_scope(_projects(spark, sf_dir), "/w/N3/all.sln", "/w")


@query("detected_root", "SELECT '/w/n3' AS root FROM supplier WHERE s_nationkey = 3 LIMIT 1")
def detected_root(spark, sf_dir):
    return solution.detected_root(_projects(spark, sf_dir), "/w/n3/deep/er/")


# --- states


@query("compatible_state", "SELECT doc_id, coalesce(lang = 'en', false) AND (trim(coalesce(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN ' 2' ELSE '1' END, '')) IN ('', '2')) AS compatible FROM documents")
def compatible_state(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    version = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, " 2").otherwise("1")
    return d.select("doc_id", delta.compatible(F.col("lang"), version, "en", S.SCHEMA_VERSION).alias("compatible"))


@query(
    "dry_run_totals",
    f"WITH {X.STATES} SELECT (SELECT count(*) FROM changed) AS changed, (SELECT count(*) FROM deleted) AS deleted, (SELECT CAST(coalesce(sum(chunk_count), 0) AS BIGINT) FROM changed) AS estimated_chunks, "
    "(SELECT CAST(coalesce(sum(chunk_count), 0) AS BIGINT) FROM prev WHERE k IN (SELECT k FROM changed) OR k IN (SELECT k FROM deleted)) AS estimated_deletes",
)
def dry_run_totals(spark, sf_dir):
    cur, prev = X.current(spark, sf_dir), X.previous(spark, sf_dir)
    return delta.dry_run_totals(delta.dry_run(cur, prev, delta.keyed(cur).select("path_key", "chunk_count")))


@query("unfinished_files", f"WITH {X.STATES} SELECT file_path FROM cur WHERE k NOT IN (SELECT lower(file_path) FROM files WHERE size % 5 = 0)")
def unfinished_files(spark, sf_dir):
    made = X.files(spark, sf_dir).select(F.upper("file_path").alias("file_path"), F.when(F.col("size") % 5 != 0, F.array(F.lit(1.0))).alias("embedding"))
    return delta.without_failed(delta.keyed(X.current(spark, sf_dir)), made).select("file_path")


@query("run_progress", "SELECT user_id, event_id, sum(1) OVER w AS files_done, CAST(sum(event_id % 7) OVER w AS BIGINT) AS chunks_done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def run_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("workspace_root"), F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("files"), (F.col("event_id") % 7).cast("long").alias("chunks"))
    return delta.running_totals(e).select(F.col("workspace_root").alias("user_id"), F.col("seq").alias("event_id"), "files_done", "chunks_done")


@query(
    "recovered_state",
    f"WITH {X.STATES}, p AS (SELECT lower(file_path) AS k, CAST(count(*) AS INTEGER) AS n FROM files JOIN (SELECT unnest(range(0, 3)) AS x) ON x <= doc_id % 3 WHERE source <> 'src1' GROUP BY 1) "
    "SELECT files.file_path, 'sha256:' || upper(sha256(content)) AS fingerprint, n AS chunk_count FROM files JOIN p ON k = lower(file_path) WHERE lang <> 'es'",
)
def recovered_state(spark, sf_dir):
    f = X.files(spark, sf_dir)
    points = f.filter("source <> 'src1'").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3))).select(F.upper("file_path").alias("file_path"))
    return transfer.recovered_state(points, f.filter("lang <> 'es'")).select("file_path", "fingerprint", "chunk_count")


@query("remapped_state", f"WITH {X.FILES} SELECT doc_id, CASE WHEN starts_with(file_path, '/ws/docs/') THEN '/books' || substr(file_path, 9) ELSE '/new' || substr(file_path, 4) END AS file_path FROM files")
def remapped_state(spark, sf_dir):
    return transfer.remapped_state(X.files(spark, sf_dir), {"/WS/": "/new", "/ws/docs": "/books/"}).select("doc_id", "file_path")


# --- points


@query(
    "stored_payload",
    f"WITH {X.FILES} SELECT doc_id, substr(file_path, 5) AS relative_path, substr(sha256('/ws'), 1, 32) AS workspace_id, 2 AS schema_version, "
    "CASE WHEN length(content) > 400 THEN substr(content, 1, 400) || '...' ELSE content END AS preview, false AS is_git_repository FROM files",
)
def stored_payload(spark, sf_dir):
    f = X.files(spark, sf_dir)
    blank = {c: F.lit(None).cast("string") for c in ("content_type", "index_profile", "symbol_kind")}
    chunks = f.withColumns(blank | {"id": F.col("doc_id").cast("string"), "language": F.col("lang"), "symbol_name": F.col("doc_id").cast("string"), "start_line": F.lit(1), "end_line": F.lit(2), "embedding": F.array(F.lit(1.0))})
    p = store.payload(chunks)
    return p.select(F.col("symbol_name").cast("long").alias("doc_id"), "relative_path", "workspace_id", "schema_version", "preview", "is_git_repository")


@query(
    "read_defaults",
    f"WITH {X.VECTORS} SELECT point_id, CASE WHEN point_id % 3 = 0 THEN 'code' ELSE content_type END AS content_type, CASE WHEN point_id % 4 = 0 THEN 'code' ELSE index_profile END AS index_profile, "
    "CASE WHEN point_id % 5 = 0 THEN '' ELSE language END AS language, CASE WHEN point_id % 7 = 0 THEN 0 ELSE start_line END AS start_line FROM vectors",
)
def read_defaults(spark, sf_dir):
    v, every = X.vectors(spark, sf_dir), lambda n: F.col("point_id") % n == 0
    gaps = {"content_type": F.when(~every(3), F.col("content_type")), "index_profile": F.when(every(4), " ").otherwise(F.col("index_profile"))}
    gaps |= {"language": F.when(~every(5), F.col("language")), "start_line": F.when(~every(7), F.col("start_line"))}
    return store.with_defaults(v.withColumns(gaps)).select("point_id", "content_type", "index_profile", "language", "start_line")


@query("source_identity", f"WITH {X.FILES} SELECT doc_id, substr(file_path, 5) AS relative_path, 'main' AS branch, true AS is_git_repository FROM files")
def source_identity(spark, sf_dir):
    who = {"workspace_root": "/ws", "repository_root": "/WS", "is_git_repository": True, "remote_url": None, "branch": "main", "commit_sha": None}
    return with_identity(X.files(spark, sf_dir), who).select("doc_id", "relative_path", "branch", "is_git_repository")


@query("brace_balance", r"SELECT doc_id, line, CAST(sum(len(regexp_extract_all(x, '\{')) - len(regexp_extract_all(x, '\}'))) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS balance FROM (SELECT doc_id, i AS line, repeat('{', CAST(i % 3 AS BIGINT)) || repeat('}', CAST(i % 2 AS BIGINT)) AS x FROM (SELECT doc_id, unnest(range(1, doc_id % 9 + 2)) AS i FROM documents))")
def brace_balance(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 9 + 1)).alias("line"))
    text = F.concat(F.repeat(F.lit("{"), (F.col("line") % 3).cast("int")), F.repeat(F.lit("}"), (F.col("line") % 2).cast("int")), F.lit(' "}}" // {'))
    code = d.select(F.col("doc_id").alias("file_path"), "line", text.alias("text"))
    return chunking.brace_ends(code).select(F.col("file_path").alias("doc_id"), "line", F.col("balance").cast("long").alias("balance"))


# --- catalogs


@query("usable_registry", f"WITH {X.REGISTRY} SELECT custkey, status FROM reg WHERE custkey % 4 > 0")
def usable_registry(spark, sf_dir):
    r = X.registry(spark, sf_dir).withColumn("collection_name", F.when(F.col("custkey") % 4 > 0, F.col("collection_name")).otherwise(" "))
    return catalog.registry_rows(r).select("custkey", "status")


@query("searchable_workspaces", f"WITH {X.REGISTRY} SELECT custkey FROM latest WHERE status = 'completed'")
def searchable_workspaces(spark, sf_dir):
    return catalog.searchable(catalog.latest_by_root(catalog.registry_rows(X.registry(spark, sf_dir)))).select("custkey")


@query("registry_upsert", f"WITH {X.REGISTRY}, n AS (SELECT * FROM latest WHERE custkey % 2 = 0) SELECT workspace_id, custkey FROM latest WHERE custkey % 2 = 1 UNION ALL SELECT workspace_id, custkey + 1000000 FROM n")
def registry_upsert(spark, sf_dir):
    latest = catalog.latest_by_root(X.registry(spark, sf_dir))
    new = latest.filter("custkey % 2 = 0").withColumn("custkey", F.col("custkey") + 1_000_000)
    return catalog.upserted_registry(latest, new).select("workspace_id", "custkey")


@query("scope_all", f"WITH {X.REGISTRY} SELECT DISTINCT workspace_root, workspace_id FROM latest WHERE status = 'completed'")
def scope_all(spark, sf_dir):
    return catalog.resolve_scope(X.registry(spark, sf_dir), X.groups(spark, sf_dir), scope="All_Indexed").select("workspace_root", "workspace_id")


@query(
    "scope_group",
    f"WITH {X.REGISTRY}, {X.GROUPS}, g AS (SELECT unnest(['/ws/n' || nk, '/ws/n' || rk]) AS k FROM grp WHERE lower(name) = 'g1') SELECT DISTINCT workspace_root FROM latest WHERE status = 'completed' AND lower(workspace_root) IN (SELECT k FROM g)",
)
def scope_group(spark, sf_dir):
    return catalog.resolve_scope(X.registry(spark, sf_dir), X.groups(spark, sf_dir), workspace_group=" G1 ").select("workspace_root")


@query(
    "scope_root",
    f"WITH {X.REGISTRY}, r AS (SELECT * FROM latest WHERE status = 'completed' AND starts_with('/ws/n3/c3/src/', lower(workspace_root) || '/')) SELECT workspace_root FROM r ORDER BY length(workspace_root) DESC LIMIT 1",
)
def scope_root(spark, sf_dir):
    return catalog.resolve_scope(X.registry(spark, sf_dir), X.groups(spark, sf_dir), workspace_root="/WS/N3/c3/src").select("workspace_root")


@query(
    "workspace_aliases",
    f"WITH {X.REGISTRY} SELECT custkey, array_to_string([regexp_extract(workspace_root, '([^/]*)$', 1), 'All.sln', 'All'] || CASE WHEN custkey % 2 = 0 THEN ['src'] ELSE [] END || [aliases[1]], '|') AS aliases FROM reg",
)
def workspace_aliases(spark, sf_dir):
    r = X.registry(spark, sf_dir)
    directories = F.when(F.col("custkey") % 2 == 0, F.array(F.lit("/ws/src"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    prior = F.array(F.get("aliases", F.lit(0)), F.lit("ALL"), F.lit("all.SLN"))
    made = catalog.aliases(F.concat("workspace_root", F.lit("/")), F.lit("/ws/All.sln"), directories, prior)
    return r.select("custkey", F.array_join(made, "|").alias("aliases"))


@query(
    "saved_groups",
    f"WITH {X.GROUPS}, old AS (SELECT lower(name) AS name, nk FROM grp WHERE source <> 'configured') SELECT name, nk FROM old WHERE name NOT IN (SELECT lower(n_name) FROM nation WHERE n_nationkey < 5) UNION ALL SELECT lower(n_name), 1000 FROM nation WHERE n_nationkey < 5",
)
def saved_groups(spark, sf_dir):
    g = X.groups(spark, sf_dir)
    new = table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(F.lower("n_name").alias("name"), F.lit("shared").alias("source"), F.array(F.lit("/ws/n1000")).alias("roots"), F.array().cast("array<string>").alias("exclude_directories"), F.lit(False).alias("is_read_only"))
    kept = catalog.saved_group(g.filter("source <> 'configured'"), new)
    return kept.select(F.lower("name").alias("name"), F.regexp_extract(F.col("roots")[0], r"(\d+)$", 1).cast("int").alias("nk"))


@query("moved_groups", "SELECT n_name AS name, '/moved/n' || n_nationkey || '|/moved/N' || n_regionkey AS roots FROM nation")
def moved_groups(spark, sf_dir):
    g = X.groups(spark, sf_dir).filter("source = 'shared'")
    return transfer.remapped_groups(g, {"/ws": "/moved"}).select("name", F.array_join("roots", "|").alias("roots"))


@query("moved_registry", f"WITH {X.REGISTRY} SELECT custkey, '/at' || substr(workspace_root, 4) AS workspace_root, substr(sha256('/at' || substr(workspace_root, 4)), 1, 32) AS workspace_id, '/at/x' AS target FROM reg")
def moved_registry(spark, sf_dir):
    r = X.registry(spark, sf_dir).withColumn("indexed_targets", F.array(F.lit("/ws/x"), F.lit("/else")))
    return transfer.remapped_registry(r, {"/ws": "/at"}).select("custkey", "workspace_root", "workspace_id", F.col("indexed_targets")[0].alias("target"))


@query("listed_workspaces", f"WITH {X.REGISTRY} SELECT custkey, row_number() OVER (ORDER BY lower(workspace_root), custkey) AS position FROM reg")
def listed_workspaces(spark, sf_dir):
    order = Window.orderBy(P.path_key(F.col("workspace_root")), "custkey")  # a registry has a row for each workspace
    return X.registry(spark, sf_dir).select("custkey", F.row_number().over(order).cast("long").alias("position"))


@query("normal_paths", r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'C:\a\f' || doc_id ELSE '/a/f' || doc_id END AS path, lower(CASE WHEN doc_id % 2 = 0 THEN 'C:\a\f' || doc_id ELSE '/a/f' || doc_id END) AS path_key FROM documents")
def normal_paths(spark, sf_dir):
    given = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("C:/a\\f"), "doc_id", F.lit("\\"))).otherwise(F.concat(F.lit("/a\\f"), "doc_id", F.lit("//")))
    path = P.normalise(given)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), P.path_key(path).alias("path_key"))


@query("staging_names", "SELECT doc_id, substr('silt-' || lpad(CAST(doc_id AS VARCHAR), 30, '0') || '-stage-20240102030405006' || lang || source, 1, 63) AS name FROM documents")
def staging_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = K.staging_name(F.concat(F.lit("silt-"), F.lpad(F.col("doc_id").cast("string"), 30, "0")), F.to_timestamp(F.lit("2024-01-02 03:04:05.006")), F.concat("lang", "source"))
    return d.select("doc_id", name.alias("name"))


@query("merged_log", "SELECT event_id FROM (SELECT DISTINCT event_id, ts FROM events) ORDER BY ts DESC, event_id DESC LIMIT 50")
def merged_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return triggers.merged_log(e.filter("event_id % 3 > 0"), e.filter("event_id % 3 < 2"), 50).select("event_id")
