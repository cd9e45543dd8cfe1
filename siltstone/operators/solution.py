"""Solutions and projects: what a solution names, what projects refer to, and what these reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import paths as P

SHARED_METADATA = ("Directory.Build.props", "Directory.Build.targets", "Directory.Packages.props", "NuGet.config", "global.json")


def joined_path(base: Column, rest: Column) -> Column:
    """``rest`` below the directory ``base``, with . and .. worked out."""
    parts = F.filter(F.split(F.concat_ws("/", base, P.slashed(rest)), "/"), lambda x: (x != "") & (x != "."))
    up = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    folded = F.aggregate(parts, F.array().cast("array<string>"), up)
    return F.concat(F.when(F.startswith(base, F.lit("/")), "/").otherwise(""), F.array_join(folded, "/"))


def solution_projects(files: DataFrame) -> DataFrame:
    """(file_path, project): projects that each solution names and that are among ``files`` (file_path, content)."""
    ext = P.extension(F.col("file_path"))
    listed = F.regexp_extract_all("content", F.lit(r'(?m)^\s*Project\([^)]*\)\s*=\s*"[^"]*",\s*"([^"]+\.csproj)"'), F.lit(1))
    quoted = F.regexp_extract_all("content", F.lit(r'(?i)"([^"]+\.csproj)"'), F.lit(1))
    names = F.when(ext == ".sln", listed).when(ext == ".slnx", quoted)
    found = files.filter(ext.isin(".sln", ".slnx")).select("file_path", F.explode(F.array_distinct(names)).alias("name"))
    return _existing(found, files, "project")


def project_references(files: DataFrame) -> DataFrame:
    """(file_path, project): projects that each project refers to and that are among ``files``.

    Elements count whatever their case and namespace; text that is no XML has none.
    """
    parsed = F.from_xml(F.col("content"), "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    names = F.regexp_extract_all("content", F.lit(r"""(?is)<(?:[\w.-]+:)?ProjectReference\b[^>]*?\bInclude\s*=\s*["']([^"']+\.csproj)["']"""), F.lit(1))
    sound = files.filter((P.extension(F.col("file_path")) == ".csproj") & parsed["_bad"].isNull())
    found = sound.select("file_path", F.explode(F.array_distinct(names)).alias("name"))
    return _existing(found, files, "project")


def _existing(found: DataFrame, files: DataFrame, name: str) -> DataFrame:
    full = found.select("file_path", joined_path(P.directory(F.col("file_path")), F.col("name")).alias("_full"))
    there = files.select(F.col("file_path").alias(name), P.path_key(F.col("file_path")).alias("_k"))
    return full.join(there, P.path_key(F.col("_full")) == F.col("_k")).select("file_path", name).distinct()


def closure(seeds: DataFrame, edges: DataFrame, checkpoint_every: int = 5) -> DataFrame:
    """(node): all that the seeds (node) reach along the edges (src, dst), the seeds included.

    Each round joins only what the last one found; it ends when a round finds nothing, so cycles end
    too. Lineage is cut every few rounds where a checkpoint folder is set.
    """
    sc = seeds.sparkSession.sparkContext
    cut = sc.getConf().get("spark.checkpoint.dir") is not None or sc._jsc.sc().getCheckpointDir().isDefined()
    reached = frontier = seeds.select("node").distinct()
    step = 0
    while True:
        step += 1
        nxt = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti")
        nxt = nxt.checkpoint() if cut and step % checkpoint_every == 0 else nxt.cache()
        if nxt.isEmpty():
            return reached
        reached = reached.unionByName(nxt)
        if cut and step % checkpoint_every == 0:
            reached = reached.checkpoint()
        frontier = nxt


def shared_metadata(directories: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(file_path): the shared build files in the directories (directory) and above, up to the root."""
    d = P.slashed(F.col("directory"))
    parts = F.split(d, "/")
    ups = directories.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("up"))
    inside = ups.filter(P.is_under(F.col("up"), F.lit(root))).select(F.lower("up").alias("_k")).distinct()
    named = files.filter(F.lower(P.file_name(F.col("file_path"))).isin(*[n.lower() for n in SHARED_METADATA]))
    return named.withColumn("_k", F.lower(P.directory(F.col("file_path")))).join(inside, "_k").select("file_path").distinct()


def solution_scope(files: DataFrame, solution: str, root: str) -> DataFrame:
    """(file_path): files of a solution: its own, those in the directories of projects that it reaches, and shared metadata."""
    named = solution_projects(files).filter(P.path_key(F.col("file_path")) == solution.lower()).select(F.col("project").alias("node"))
    projects = closure(named, project_references(files).select(F.col("file_path").alias("src"), F.col("project").alias("dst")))
    dirs = projects.select(P.directory(F.col("node")).alias("directory")).distinct()
    parts = F.split(F.lower(P.directory(F.col("file_path"))), "/")
    above = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("_k"))
    inside = above.join(dirs.select(F.lower("directory").alias("_k")), "_k", "left_semi").select("file_path")
    own = files.filter(P.path_key(F.col("file_path")) == solution.lower()).select("file_path")
    return inside.unionByName(shared_metadata(dirs, files, root)).unionByName(own).distinct()


def detected_root(files: DataFrame, start: str) -> DataFrame:
    """(root): the nearest directory from ``start`` up with a .git directory or a solution, else the nearest with a project, else ``start``.

    ``files`` has file_path; a path below ``.git/`` shows the directory.
    """
    s = start.replace("\\", "/").rstrip("/")
    ups = ["/".join(s.split("/")[:n]) for n in range(len(s.split("/")), 0, -1)]
    order = F.array(*[F.lit(u.lower()) for u in ups])
    path = P.slashed(F.col("file_path"))
    git = F.regexp_extract(path, r"^(.*?)/\.git/", 1)
    ext = P.extension(F.col("file_path"))
    place = F.when(git != "", git).when(ext.isin(".sln", ".csproj"), P.directory(F.col("file_path")))
    strength = F.when(git != "", 0).when(ext == ".sln", 0).otherwise(1)
    marks = files.select(strength.alias("strength"), F.array_position(order, F.lower(place)).alias("depth"), place.alias("root")).filter("depth > 0")
    best = marks.agg(F.min(F.struct("strength", "depth", "root"))["root"].alias("root"))
    return best.select(F.coalesce("root", F.lit(s)).alias("root"))
