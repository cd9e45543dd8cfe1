"""Export, import and recovery of indexed workspaces, with remapped roots."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas as S
from siltstone.functions import keys as K
from siltstone.functions import paths as P

FORMAT = "siltstone-export"
KINDS = ("workspace", "group")


def mapped_root(path: Column, mapping: Mapping[str, str]) -> Column:
    """The path under its new root; of several old roots that hold it the longest counts. Null if none does."""
    out = F.lit(None).cast("string")
    for old, new in sorted(mapping.items(), key=lambda kv: len(kv[0])):
        below = P.relative(path, F.lit(old))
        new = new.rstrip("/\\")
        placed = F.when(below == "", F.lit(new)).otherwise(F.concat(F.lit(new + "/"), below))
        out = F.when(P.is_under(path, F.lit(old)), placed).otherwise(out)
    return out


def required(value: Column, label: str, what: Column) -> Column:
    """The value; reading a null one fails and says what had no place."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{label}: "), F.coalesce(what, F.lit("?")))))


def remapped_points(points: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Points under new roots: root, workspace id and paths follow; point ids stay, as they are keys and no more."""
    root = required(mapped_root(F.col("workspace_root"), mapping), "no new root for", F.col("workspace_root"))
    path = F.coalesce(mapped_root(F.col("file_path"), mapping), F.concat_ws("/", root, F.col("relative_path")))
    repository = F.coalesce(mapped_root(F.col("repository_root"), mapping), F.col("repository_root"))
    return points.withColumns({"_root": root, "_path": path, "_repo": repository}).withColumns(
        {"workspace_root": F.col("_root"), "file_path": F.col("_path"), "repository_root": F.col("_repo"), "workspace_id": K.workspace_id(F.col("_root"))}
    ).drop("_root", "_path", "_repo")


def remapped_state(state: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """A file state under new roots."""
    return state.withColumn("file_path", required(mapped_root(F.col("file_path"), mapping), "no new root for", F.col("file_path")))


def remapped_registry(registry: DataFrame, mapping: Mapping[str, str], prefix: str = "siltstone") -> DataFrame:
    """Registry rows under new roots, with their ids, collections and indexed targets."""
    root = required(mapped_root(F.col("workspace_root"), mapping), "no new root for", F.col("workspace_root"))
    out = registry.withColumn("workspace_root", root)
    wid = K.workspace_id(F.col("workspace_root"))
    return out.withColumns(
        {
            "workspace_id": wid,
            "collection_name": K.collection_name(F.lit(prefix), wid),
            "indexed_targets": F.transform("indexed_targets", lambda t: F.coalesce(mapped_root(t, mapping), t)),
        }
    )


def export(points: DataFrame, registry: DataFrame, folder: str, kind: str = "workspace", prefix: str = "siltstone", groups: DataFrame | None = None) -> None:
    """Points as JSON lines, and a manifest of what they are: a workspace, or a group with all of its own."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    points.write.mode("overwrite").json(f"{folder}/points")
    listed = lambda df, by: [json.loads(r) for r in df.orderBy(by).toJSON().collect()]  # noqa: E731  a row for each exported workspace or group
    manifest = {"format": FORMAT, "schema_version": S.SCHEMA_VERSION, "prefix": prefix, "kind": kind, "workspaces": listed(registry, "workspace_root")}
    if groups is not None:
        manifest["groups"] = listed(groups, "name")
    spark = points.sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def remapped_groups(groups: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Groups with their roots under new ones; a root that has no new place is an error."""
    return groups.withColumn("roots", F.transform("roots", lambda r: required(mapped_root(r, mapping), "no new root for", r)))


def read_manifest(spark: SparkSession, folder: str) -> dict:
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifest").collect()))
    if manifest.get("format") != FORMAT:
        raise ValueError(f"not an export: {manifest.get('format')!r}")
    if manifest.get("kind") not in KINDS:
        raise ValueError(f"unknown kind {manifest.get('kind')!r}")
    S.check_schema_version(manifest.get("schema_version"))
    return manifest


def read_points(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Exported points; blank lines are left out."""
    lines = spark.read.text(f"{folder}/points").filter(F.trim("value") != "")
    return lines.select(F.from_json("value", like.schema).alias("p")).select("p.*")


def recovered_state(points: DataFrame, files: DataFrame, by_content: bool = True) -> DataFrame:
    """A file state from stored points: chunks of each file that still exists, fingerprinted as a run would.

    ``files`` has file_path, content, size and last_write_time_utc.
    """
    counts = points.groupBy(P.path_key(F.col("file_path")).alias("_k")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    print_ = K.content_fingerprint(F.col("content")) if by_content else K.metadata_fingerprint(F.col("size"), F.col("last_write_time_utc"))
    there = files.select("file_path", print_.alias("fingerprint"), "size", "last_write_time_utc", P.path_key(F.col("file_path")).alias("_k"))
    return there.join(counts, "_k").drop("_k")


def recovery_summary(points: DataFrame, files: DataFrame) -> DataFrame:
    """One row: points scanned, files found, files that are gone."""
    seen = points.groupBy(P.path_key(F.col("file_path")).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    there = files.select(P.path_key(F.col("file_path")).alias("_k"), F.lit(True).alias("there")).distinct()
    return seen.join(there, "_k", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("points_scanned"), F.count_if(F.col("there")).alias("files"), F.count_if(F.col("there").isNull()).alias("missing")
    )
