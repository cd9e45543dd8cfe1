"""Scans of source trees: files as rows, pruned and filtered by path and content."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas as S
from siltstone.functions import classify as C
from siltstone.functions import keys as K
from siltstone.functions import paths as P
from siltstone.sources import tree_source

if TYPE_CHECKING:
    import pyarrow as pa


_FOUND = tree_source.FOUND
#: Shares of a tree for each core.
SHARES = 4


def tree(
    spark: SparkSession, root: str, pattern: str | None = None, excluded_directories: Sequence[str] = (), below: Sequence[str] = (), characters: int | None = None
) -> DataFrame:
    """(workspace_root, file_path, content, size, last_write_time_utc) of every file below ``root``.

    Excluded directories are neither listed nor opened, wherever the tree is; with ``below`` only what
    leads to these paths is. ``characters`` reads no more than so many of each file, 0 none. Bytes that
    are no UTF-8 become replacement characters. A store that only Spark reaches is listed as a whole.
    """
    if pattern is None and tree_source.can_list(root):
        spark.dataSource.register(tree_source.TreeSource)
        options = {"root": root, "excluded": json.dumps(list(excluded_directories)), "below": json.dumps(list(below)), "partitions": SHARES * spark.sparkContext.defaultParallelism}
        reader = spark.read.format("siltstone_tree").options(**options)
        return (reader if characters is None else reader.option("characters", characters)).load()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return _rows(reader.load(root), root)


def read_files(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """The same of the named files."""
    if not paths:
        return spark.createDataFrame([], _FOUND)
    literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]  # names are no patterns
    return _rows(spark.read.format("binaryFile").load(literal), root)


def whole_contents(files: DataFrame) -> DataFrame:
    """The same rows with all of each file that has a content, where only the beginning was read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        walks: dict[str, tree_source.Walk] = {}
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            roots, paths, texts = (batch.column(at[c]).to_pylist() for c in ("workspace_root", "file_path", "content"))
            new = []
            for root, path, text in zip(roots, paths, texts, strict=True):
                walk = walks.setdefault(root, tree_source.Walk(root)) if text is not None else None
                new.append(walk.content(path, None) if walk else None)
            yield batch.set_column(at["content"], "content", pa.array(new, pa.string()))

    return files.mapInArrow(read, files.schema)


def _rows(found: DataFrame, root: str) -> DataFrame:
    return found.select(
        F.lit(root).alias("workspace_root"),
        F.regexp_replace("path", "^file:(//)?", "").alias("file_path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_write_time_utc"),
    )


def in_scope(path: Column, root: Column, content: Column | None, excluded_directories: Sequence[str], excluded_files: Sequence[str], profile: str = "all", skip_generated: bool = True) -> Column:
    """Whether a scan takes a file: some analyzer accepts it, nothing excludes it, and its guessed profile fits."""
    taken = F.lit(False)
    for ok in C.accepts(path).values():
        taken = taken | ok
    out = taken & ~P.excluded_directory(path, root, excluded_directories) & ~P.excluded_file(path, root, excluded_files)
    if skip_generated and content is not None:
        out = out & ~F.coalesce(C.is_auto_generated(path, content), F.lit(False))
    profile = S.normal_profile(profile)
    return out if profile == "all" else out & (C.index_profile(path, C.guessed_content_type(path)) == profile)


def scanned(files: DataFrame, excluded_directories: Sequence[str] = C.DEFAULT_EXCLUDED_DIRECTORIES, excluded_files: Sequence[str] = C.DEFAULT_EXCLUDED_FILES, profile: str = "all", skip_generated: bool = True) -> DataFrame:
    """Files that a scan takes, one row for each path whatever its case."""
    keep = in_scope(F.col("file_path"), F.col("workspace_root"), F.col("content"), excluded_directories, excluded_files, profile, skip_generated)
    once = files.filter(keep).groupBy("workspace_root", P.path_key(F.col("file_path")).alias("_k"))
    return once.agg(F.min_by(F.struct(*files.columns), "file_path").alias("row")).select("row.*")


def targets(files: DataFrame, roots: Sequence[str], singles: Sequence[str] = ()) -> DataFrame:
    """Files below any of the roots, and the single ones."""
    inside = P.path_key(F.col("file_path")).isin(*[s.lower() for s in singles]) if singles else F.lit(False)
    for r in roots:
        inside = inside | P.is_under(F.col("file_path"), F.lit(r))
    return files.filter(inside)


def target_files(files: DataFrame, target: str, excluded_directories: Sequence[str] = (), excluded_files: Sequence[str] = ()) -> DataFrame:
    """(file_path, scanned): a single file as a target; excluded or of no analyzer it is not scanned, but may still be deleted."""
    one = files.filter(P.path_key(F.col("file_path")) == target.lower())
    return one.select("file_path", in_scope(F.col("file_path"), F.col("workspace_root"), None, excluded_directories, excluded_files, skip_generated=False).alias("scanned"))


def fingerprinted(files: DataFrame, by_content: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a file state without chunk counts, and the columns to ``keep``; by size and time, contents are never read."""
    print_ = K.content_fingerprint(F.col("content")) if by_content else K.metadata_fingerprint(F.col("size"), F.col("last_write_time_utc"))
    return files.select("file_path", print_.alias("fingerprint"), "size", "last_write_time_utc", F.lit(0).alias("chunk_count"), *keep)
