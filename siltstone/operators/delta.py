"""Incremental indexing: fingerprints against the stored state, as joins on the path's key.

``current`` has a row for each file found now, ``previous`` one for each file of the stored state:
file_path, fingerprint, size, last_write_time_utc, chunk_count. Paths compare without case,
fingerprints with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.paths import path_key


def keyed(files: DataFrame, name: str = "file_path") -> DataFrame:
    """One row for each path, the first spelling in order."""
    return (
        files.withColumn("path_key", path_key(F.col(name)))
        .groupBy("path_key")
        .agg(F.min_by(F.struct(*files.columns), name).alias("row"))
        .select("path_key", "row.*")
    )


def changed_files(current: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """Files to index again: all of them if forced, else new ones and those with another fingerprint."""
    cur, old = keyed(current), keyed(previous).select("path_key", F.col("fingerprint").alias("old"))
    joined = cur.join(old, "path_key", "left")
    return joined.filter(F.lit(force) | F.col("old").isNull() | (F.col("old") != F.col("fingerprint"))).drop("old")


def deleted_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files of the state that are gone."""
    return keyed(previous).join(keyed(current).select("path_key"), "path_key", "left_anti")


def preserved_files(previous: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Files of the state that stay as they are."""
    touched = changed.select("path_key").unionByName(deleted.select("path_key"))
    return keyed(previous).join(touched, "path_key", "left_anti")


def unchanged_count(current: DataFrame, changed: DataFrame) -> DataFrame:
    return keyed(current).join(changed.select("path_key"), "path_key", "left_anti").agg(F.count(F.lit(1)).alias("unchanged"))


def backfilled(current: DataFrame, counted: DataFrame, previous: DataFrame) -> DataFrame:
    """Chunk counts: the new one, else the state's, else the row's own."""
    new = counted.select("path_key", F.col("chunk_count").alias("new"))
    old = keyed(previous).select("path_key", F.col("chunk_count").alias("old"))
    joined = keyed(current).join(new, "path_key", "left").join(old, "path_key", "left")
    return joined.withColumn("chunk_count", F.coalesce("new", "old", "chunk_count")).drop("new", "old")


def merged_state(previous: DataFrame, current: DataFrame, in_scope) -> DataFrame:
    """The state after a scoped run: what was out of scope stays, what is current replaces the rest."""
    cur = keyed(current)
    kept = keyed(previous).filter(~in_scope).join(cur.select("path_key"), "path_key", "left_anti")
    return kept.unionByName(cur)


def checkpoint_state(previous: DataFrame, current: DataFrame, changed: DataFrame, deleted: DataFrame, done: DataFrame) -> DataFrame:
    """The state in the middle of a run: what is not touched, plus the current files that are done (path_key, chunk_count)."""
    kept = preserved_files(previous, changed, deleted)
    finished = keyed(current).drop("chunk_count").join(done.select("path_key", "chunk_count"), "path_key")
    return kept.unionByName(finished.select(*kept.columns))


def dry_run(current: DataFrame, previous: DataFrame, estimates: DataFrame, force: bool = False) -> DataFrame:
    """What a run would do to each file: flags, chunks now and then (estimates: path_key, chunk_count)."""
    changed, gone = changed_files(current, previous, force), deleted_files(current, previous)
    paths = keyed(current).select("path_key", "file_path").unionByName(gone.select("path_key", "file_path"))
    old = keyed(previous).select("path_key", F.col("chunk_count").alias("old"))
    est = estimates.select("path_key", F.col("chunk_count").alias("est"))
    flag = lambda df, name: df.select("path_key", F.lit(True).alias(name))
    joined = paths.join(old, "path_key", "left").join(est, "path_key", "left").join(flag(changed, "c"), "path_key", "left").join(flag(gone, "d"), "path_key", "left")
    is_changed, is_deleted = F.coalesce("c", F.lit(False)), F.coalesce("d", F.lit(False))
    return joined.select(
        "file_path",
        is_changed.alias("changed"),
        is_deleted.alias("deleted"),
        F.coalesce("old", F.lit(0)).alias("current_chunks"),
        F.when(is_changed, F.coalesce("est", F.lit(0))).otherwise(0).alias("estimated_chunks"),
        F.when(is_changed | is_deleted, F.coalesce("old", F.lit(0))).otherwise(0).alias("estimated_deletes"),
    )


def dry_run_totals(plan: DataFrame) -> DataFrame:
    """One row of what ``dry_run`` says: files changed and deleted, chunks to make and to delete."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return plan.agg(
        F.count_if("changed").alias("changed"), F.count_if("deleted").alias("deleted"), n("estimated_chunks").alias("estimated_chunks"), n("estimated_deletes").alias("estimated_deletes")
    )


def compatible(model: Column, schema_version: Column, wanted_model: str, wanted_version: int) -> Column:
    """Whether a stored state can be continued: same model by exact name, and a blank or equal schema version."""
    version = F.trim(F.coalesce(schema_version, F.lit("")))
    return F.coalesce(model == wanted_model, F.lit(False)) & ((version == "") | (version == str(wanted_version)))


def without_failed(state: DataFrame, made: DataFrame) -> DataFrame:
    """State rows (path_key) less files of which a chunk (file_path, embedding) got no vector: the next run does them again."""
    failed = made.filter("embedding IS NULL").select(path_key(F.col("file_path")).alias("path_key")).distinct()
    return state.join(failed, "path_key", "left_anti")


def running_totals(steps: DataFrame) -> DataFrame:
    """``steps`` (workspace_root, seq, files, chunks) of runs, with what each run has done up to each step."""
    upto = Window.partitionBy("workspace_root").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumns({"files_done": F.sum("files").over(upto), "chunks_done": F.sum("chunks").over(upto)})


def resumed(changed: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Files that a stopped run still has to do."""
    done = keyed(checkpoint).select("path_key", F.col("fingerprint").alias("done"))
    return changed.join(done, "path_key", "left").filter(F.col("done").isNull() | (F.col("done") != F.col("fingerprint"))).drop("done")


def overlay(changes: DataFrame) -> DataFrame:
    """(path, op): the last change of each path; ``changes`` has path, op and a growing ``seq``."""
    last = changes.groupBy(path_key(F.col("path")).alias("path_key")).agg(F.max_by(F.struct("path", "op"), "seq").alias("row"))
    return last.select("row.path", "row.op")


def restricted(changes: DataFrame, candidates: DataFrame, previous: DataFrame) -> DataFrame:
    """Changes (path, op) of files that a scan takes or the state knows; the rest is not the index's concern."""
    known = candidates.select(path_key(F.col("file_path")).alias("_k")).unionByName(previous.select(path_key(F.col("file_path")).alias("_k"))).distinct()
    return changes.withColumn("_k", path_key(F.col("path"))).join(known, "_k", "left_semi").drop("_k")


def planned(changes: DataFrame | None, complete: bool, current: DataFrame, previous: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changed, deleted) of a run.

    A complete list of changes replaces the comparison with the state, unless the run is forced: what
    it names is changed if it is there now, and deleted if the state knows it and it is gone. Else
    all files are compared.
    """
    if changes is None or not complete or force:
        return changed_files(current, previous, force), deleted_files(current, previous)
    last = overlay(restricted(changes, current, previous)).select(path_key(F.col("path")).alias("path_key"), "op")
    changed = keyed(current).join(last.filter("op = 'change'").select("path_key"), "path_key", "left_semi")
    gone = keyed(previous).join(last.select("path_key"), "path_key", "left_semi").join(keyed(current).select("path_key"), "path_key", "left_anti")
    return changed, gone


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(path_key(F.col("file_path")).alias("path_key")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))


#: Ranges of paths that ranks are counted in.
PAGE_RANGES = 256


def state_pages(state: DataFrame, page_files: int = 512) -> DataFrame:
    """The state's files with their page, in order of directory and path.

    Rows are dealt by ranges of (directory, path), so a flat directory of any size is split; each
    part ranks its own rows and adds what the parts before it hold, one number a part.
    """
    named = state.withColumn("_k", path_key(F.col("file_path"))).withColumn("_d", F.regexp_replace("_k", "[^/]*$", ""))
    parts = named.repartitionByRange(PAGE_RANGES, "_d", "_k", "file_path").withColumn("_p", F.spark_partition_id())
    counts = parts.groupBy("_p").count()
    before = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    order = Window.partitionBy("_p").orderBy("_d", "_k", "file_path")
    placed = parts.join(F.broadcast(before), "_p").withColumn("_n", F.col("_base") + F.row_number().over(order) - 1)
    return placed.withColumn("page", F.floor(F.col("_n") / page_files).cast("int")).drop("_d", "_k", "_p", "_base", "_n")


def index_summary(state: DataFrame) -> DataFrame:
    """Files and chunks of a state, and when it was last written."""
    return state.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.max("last_write_time_utc").alias("last_write"))
