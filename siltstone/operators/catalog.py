"""Registry of indexed workspaces, groups, and the resolution of scopes and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schemas as S
from siltstone.functions import paths as P

PRIORITY = {"configured": 0, "local": 1, "shared": 2}


def registry_rows(rows: DataFrame) -> DataFrame:
    """Usable registry rows by root: those with root, id and collection; an unknown status is completed."""
    good = [F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("workspace_root", "workspace_id", "collection_name")]
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    return rows.filter(good[0] & good[1] & good[2]).withColumn("status", F.when(status == "indexing", status).otherwise("completed"))


def searchable(registry: DataFrame) -> DataFrame:
    return registry.filter(F.lower("status") == "completed")


def latest_by_root(registry: DataFrame) -> DataFrame:
    """The row of each root that was written last."""
    order = Window.partitionBy(P.path_key(F.col("workspace_root"))).orderBy(F.col("last_indexed_utc").desc_nulls_last(), F.col("collection_name").desc())
    return registry.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def overlaid_groups(*sources: DataFrame) -> DataFrame:
    """One row for each group name: configured before local before shared, names without case."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    rank = F.coalesce(*[F.when(F.lower("source") == k, v) for k, v in PRIORITY.items()], F.lit(len(PRIORITY)))
    order = Window.partitionBy(F.lower(F.trim("name"))).orderBy(rank, "name")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def saved_group(groups: DataFrame, new: DataFrame) -> DataFrame:
    """``groups`` with ``new`` in place of those of its names; reading fails on a configured name or no roots."""
    name = F.lower(F.trim("name"))
    fixed = groups.filter(F.lower("source") == "configured").select(name.alias("_k"), F.lit(True).alias("_fixed"))
    ok = new.withColumn("_k", name).join(fixed, "_k", "left")
    bad = F.when(F.col("_fixed"), F.raise_error(F.concat(F.lit("a configured group cannot change: "), "name"))).when(
        F.size("roots") < 1, F.raise_error(F.concat(F.lit("a group needs a root: "), "name"))
    )
    ok = ok.withColumn("name", F.coalesce(bad.cast("string"), F.col("name"))).drop("_fixed")
    kept = groups.withColumn("_k", name).join(ok.select("_k"), "_k", "left_anti")
    return kept.unionByName(ok.select(*kept.columns)).drop("_k")


def group_members(groups: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, workspace_root, workspace_id, collection_name) of each group's indexed roots."""
    roots = groups.select("name", F.explode("roots").alias("root")).withColumn("_k", P.path_key(F.col("root")))
    known = registry.select("workspace_root", "workspace_id", "collection_name").withColumn("_k", P.path_key(F.col("workspace_root")))
    return roots.join(known, "_k").drop("_k", "root").distinct()


def deepest_workspace(paths: DataFrame, registry: DataFrame) -> DataFrame:
    """``paths`` (path) with the indexed workspace that holds each most closely: an equi-join on ancestors.

    Each path meets its own ancestors only, so the join grows with the depth of paths, not with the
    number of workspaces.
    """
    parts = F.split(F.lower(P.slashed(F.col("path"))), "/")
    ups = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("_k"))
    known = registry.select("workspace_root", "workspace_id").withColumn("_k", F.rtrim(F.lower(P.slashed(F.col("workspace_root"))), F.lit("/")))
    found = ups.filter("_k <> ''").join(known, "_k").groupBy("path").agg(F.max_by(F.struct("workspace_root", "workspace_id"), F.struct(F.length("_k"), F.col("workspace_root"))).alias("w"))
    return paths.join(found, "path", "left").select("path", "w.workspace_root", "w.workspace_id")


def aliased(registry: DataFrame, name: str) -> DataFrame:
    """Rows that have the name among their aliases, whatever its case."""
    return registry.filter(F.exists("aliases", lambda a: F.lower(a) == name.strip().lower()))


def ordered_distinct(values: Column) -> Column:
    """Values without blanks and repeats (whatever their case), each in its first spelling and place."""
    clean = F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != ""))
    first = lambda v, i: F.array_position(F.transform(clean, F.lower), F.lower(v)) == i + 1
    return F.filter(clean, first)


def aliases(root: Column, solution: Column, directories: Column, prior: Column) -> Column:
    """Directory name, solution file with and without extension, directories, then earlier aliases."""
    name = P.file_name(F.rtrim(P.slashed(root), F.lit("/")))
    own = F.array(name, F.when(solution.isNotNull(), P.file_name(solution)), F.when(solution.isNotNull(), P.stem(solution)))
    return ordered_distinct(F.concat(own, F.transform(directories, P.file_name), prior))


def upserted_registry(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by workspace id, the new ones in place of old."""
    return registry.join(new.select("workspace_id"), "workspace_id", "left_anti").unionByName(new.select(*registry.columns))


def is_path_like(name: str) -> bool:
    """Whether a target names a path and not an alias."""
    import re

    return bool(re.match(r"^([A-Za-z]:|[\\/~.])", name)) or "/" in name or "\\" in name


def resolve_scope(
    registry: DataFrame,
    groups: DataFrame,
    scope: str | None = None,
    workspace_root: str | None = None,
    workspace_group: str | None = None,
    current: str | None = None,
    expand_groups: bool = False,
) -> DataFrame:
    """Completed workspaces that a search covers: workspace_root, workspace_id, collection_name.

    A group gives its indexed roots; a root (or the current path) the deepest workspace that holds it,
    or the one with that alias; ``all`` every completed one. ``expand_groups`` adds the members of
    groups that hold a found workspace.
    """
    kind = S.normal_scope(scope, workspace_root, workspace_group)
    ready = searchable(latest_by_root(registry_rows(registry)))
    columns = ["workspace_root", "workspace_id", "collection_name"]
    if kind == "all":
        found = ready.select(*columns)
    elif kind == "group":
        wanted = (workspace_group or "").strip().lower()
        found = group_members(groups.filter(F.lower(F.trim("name")) == wanted), ready).select(*columns)
    else:
        target = (workspace_root if kind == "root" else current) or ""
        if target and not is_path_like(target):
            return aliased(ready, target).select(*columns)
        paths = ready.sparkSession.createDataFrame([(target,)], "path string")
        hit = deepest_workspace(paths, ready).filter("workspace_id IS NOT NULL").select("workspace_id")
        found = ready.join(hit, "workspace_id", "left_semi").select(*columns)
    if expand_groups and kind != "group":
        members = group_members(groups, ready)
        names = members.join(found.select("workspace_id"), "workspace_id", "left_semi").select("name").distinct()
        found = found.unionByName(members.join(names, "name", "left_semi").select(*columns))
    return found.distinct()


def allowed(roots: Sequence[str], allow_list: Sequence[str]) -> None:
    """Raise where a root lies outside of the allowed ones; an empty list allows all."""
    low = [a.replace("\\", "/").rstrip("/").lower() for a in allow_list if a.strip()]
    for r in roots:
        key = r.replace("\\", "/").rstrip("/").lower()
        if low and not any(key == a or key.startswith(a + "/") for a in low):
            raise PermissionError(f"{r} is outside of the allowed workspaces")
