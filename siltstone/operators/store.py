"""Versioned vector tables: keyed upsert and deletes as segments, promotion as a pointer.

A table's folder holds segments (``data``: points and file states, with deletion bitmaps, see
``segments``) and ``v=<n>`` folders, each with a manifest: which segments its points and its file state
are, and a head, what it says of itself. A change writes segments in proportion to it and a manifest.
Which version is active says the last of the pointers, empty files named ``active-<number>-v<n>``:
making one is a single step, so readers see the old version or the new one, with its own state, and
never neither. The version before stays for rollback; segments that no version names go.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas as S
from siltstone.functions import keys as K
from siltstone.functions import paths as P
from siltstone.functions import text as T
from siltstone.operators.segments import KEY, Manifest, Segments


def payload(chunks: DataFrame) -> DataFrame:
    """Chunks with an embedding as stored points: id, vector and the payload's columns."""
    own = set(chunks.columns)
    source = {"repository_root", "remote_url", "branch", "commit_sha", "source_workspace_id", "source_project_id"}
    made = {
        "workspace_id": K.workspace_id(F.col("workspace_root")),
        "schema_version": F.lit(S.SCHEMA_VERSION),
        "relative_path": P.relative(F.col("file_path"), F.col("workspace_root")),
        "preview": T.preview(F.col("content")),
        "is_git_repository": F.col("is_git_repository") if "is_git_repository" in own else F.lit(False),
        **{c: (F.col(c) if c in own else F.lit(None).cast("string")) for c in source},
    }
    named = chunks.withColumns(made)
    return named.select(K.point_id(F.col("workspace_id"), F.col("id")).alias("point_id"), "embedding", *S.PAYLOAD)


def with_defaults(points: DataFrame) -> DataFrame:
    """Points as read: blank profile and content type mean code, missing strings are empty, missing lines 0."""
    strings = [f.name for f in points.schema if f.dataType.simpleString() == "string" and f.name in S.PAYLOAD]
    filled = points.withColumns({c: F.coalesce(c, F.lit("")) for c in strings} | {c: F.coalesce(c, F.lit(0)) for c in ("start_line", "end_line") if c in points.columns})
    code = {c: F.when(F.trim(c) == "", "code").otherwise(F.col(c)) for c in ("index_profile", "content_type") if c in points.columns}
    return filled.withColumns(code)


def checked_vectors(points: DataFrame, width: int | None = None) -> DataFrame:
    """Points; reading them fails on an empty vector or one of another width than the first given."""
    size = F.size("embedding")
    good = (size > 0) if width is None else (size == width)
    return points.withColumn("embedding", F.when(good, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("vector of width "), size.cast("string")))))


def last_of_each(new: DataFrame, key: str = "point_id") -> DataFrame:
    """One row for each key, the last by content."""
    return new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("row")).select(key, "row.*")


def upserted(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """Old rows whose key is not in ``new``, and ``new``; of equal keys in ``new`` the last by content stays."""
    last = last_of_each(new, key)
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(*old.columns))


def without_files(points: DataFrame, workspace: str, paths: DataFrame) -> DataFrame:
    """Points of a workspace less those of ``paths`` (file_path)."""
    gone = paths.select(P.path_key(F.col("file_path")).alias("_key"), F.lit(workspace).alias("_ws")).distinct()
    here = points.withColumn("_path", P.path_key(F.col("file_path")))
    return here.join(gone, (here["_path"] == gone["_key"]) & (here["workspace_id"] == gone["_ws"]), "left_anti").drop("_path")


def of_files(points: DataFrame, workspace: str, paths: DataFrame) -> DataFrame:
    """Points of a workspace that are of ``paths`` (file_path)."""
    wanted = paths.select(P.path_key(F.col("file_path")).alias("_wanted")).distinct()
    here = points.filter(F.col("workspace_id") == workspace)
    return here.join(wanted, P.path_key(here["file_path"]) == wanted["_wanted"], "left_semi")


def without_directories(points: DataFrame, workspace: str, directories: Sequence[str]) -> DataFrame:
    """Points of a workspace less those in or below any of the directories."""
    inside = F.lit(False)
    for d in directories:
        inside = inside | P.is_under(F.col("file_path"), F.lit(d))
    return points.filter(~((F.col("workspace_id") == workspace) & inside))


class VectorStore:
    """Vector tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v={version}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self, name: str) -> list[int]:
        fs, where = self._fs(f"{self.root}/{name}")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def pointers(self, name: str) -> list[tuple[int, int]]:
        """(number, version) of the pointers, in order."""
        fs, where = self._fs(f"{self.root}/{name}")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted((int(m[1]), int(m[2])) for n in names if (m := re.fullmatch(r"active-(\d+)-v(\d+)", n)))

    def active(self, name: str) -> int | None:
        found = self.pointers(name)
        return found[-1][1] if found else None

    def _text(self, path: str) -> str | None:
        fs, where = self._fs(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _manifest(self, name: str, version: int) -> dict:
        text = self._text(f"{self.path(name, version)}/manifest")
        if text is None:
            raise LookupError(f"version {version} of {name} has no manifest")
        return json.loads(text)

    def _segments(self, name: str, columns: Sequence[str]) -> Segments:
        """Segments ordered by path, so that what is below a directory is a range of rows."""
        by = P.sort_key(F.col("file_path")) if "file_path" in columns else F.col(columns[0])
        return Segments(self.spark, f"{self.root}/{name}/data", lambda: by)

    def _part(self, name: str, part: str, version: int | None = None) -> tuple[Segments, Manifest]:
        version = self.active(name) if version is None else version
        if version is None:
            raise LookupError(f"no active version of {name}")
        found = self._manifest(name, version).get(part)
        if found is None:
            raise LookupError(f"version {version} of {name} has no {part}")
        return self._segments(name, found["columns"]), Manifest(found["data"], found["bits"])

    def read(self, name: str, part: str = "points") -> DataFrame:
        segments, manifest = self._part(name, part)
        return segments.read(manifest)

    def read_below(self, name: str, directory: str, part: str = "points") -> DataFrame:
        """Rows in or below a directory; the range of paths reaches the scan."""
        segments, manifest = self._part(name, part)
        return segments.read(manifest, lambda key: P.subtree(key, directory))

    def segments_of(self, name: str) -> list[str]:
        """Data segments of the active version's points."""
        return self._part(name, "points")[1].data

    def read_since(self, name: str, known: Sequence[str]) -> DataFrame:
        """Points of segments that are not among ``known`` ones."""
        segments, manifest = self._part(name, "points")
        new = [d for d in manifest.data if d not in set(known)]
        return segments.read(Manifest(new, manifest.bits)) if new else self.read(name).limit(0)

    def bytes_written(self, name: str) -> int:
        """Bytes of all segments that are there."""
        fs, where = self._fs(f"{self.root}/{name}/data")
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def head(self, name: str) -> dict | None:
        """What the active version says of itself; None without one."""
        version = self.active(name)
        return None if version is None else self._manifest(name, version).get("head")

    def _commit(self, name: str, parts: dict[str, tuple[Sequence[str], Manifest]], head: dict | None) -> int:
        """Write a manifest as a new version, not yet active."""
        version = max(self.versions(name), default=0) + 1
        told = {part: {"columns": list(c), "data": m.data, "bits": m.bits} for part, (c, m) in parts.items()}
        fs, where = self._fs(f"{self.path(name, version)}/manifest")
        out = fs.create(where, False)
        out.write(bytearray(json.dumps(told | {"head": head}).encode()))
        out.close()
        return version

    def build(self, name: str, points: DataFrame, width: int | None = None, state: DataFrame | None = None, head: dict | None = None) -> int:
        """Write ``points`` as a new version with its ``state`` and ``head``, not yet active."""
        if width is None and self.active(name) is not None:
            width = self.width(name)
        rows = checked_vectors(points, width) if "embedding" in points.columns else points
        whole = {"points": rows} | ({} if state is None else {"state": state})
        made = {part: (df.columns, Manifest([self._segments(name, df.columns).append(df)])) for part, df in whole.items()}
        return self._commit(name, made, head)

    def change(
        self,
        name: str,
        points: DataFrame | None = None,
        gone: Sequence[Callable[[DataFrame], DataFrame]] = (),
        width: int | None = None,
        state: DataFrame | None = None,
        head: dict | None = None,
    ) -> int:
        """A new version, not yet active, in which ``points`` replace those with their ids and what any of ``gone`` picks is no more.

        ``state`` is the whole new file state, of which only rows that differ are written; without it
        and without ``head`` the active version's stay.
        """
        segments, manifest = self._part(name, "points")
        rows = segments.live(manifest)
        dead = [pick(rows) for pick in gone]
        columns = self._manifest(name, self.active(name))["points"]["columns"]
        if points is not None:
            checked = checked_vectors(points, self.width(name) if width is None else width) if "embedding" in points.columns else points
            points = last_of_each(checked).select(*columns)
            dead.append(rows.join(points.select("point_id"), "point_id", "left_semi").select(rows.columns))
        # a row that is picked twice sets its bit twice
        all_dead = reduce(DataFrame.unionByName, dead) if dead else None
        parts = {"points": (columns, segments.changed(manifest, points, all_dead))}
        before = self._manifest(name, self.active(name))
        if state is not None and before.get("state"):
            held, old = self._part(name, "state")
            known, names = held.live(old), before["state"]["columns"]
            now, was = state.select(*names).alias("now"), known.alias("was")
            same = reduce(lambda a, b: a & b, [F.col(f"now.{c}").eqNullSafe(F.col(f"was.{c}")) for c in names])
            parts["state"] = (names, held.changed(old, now.join(was, same, "left_anti"), was.join(now, same, "left_anti")))
        elif state is not None:
            parts["state"] = (state.columns, Manifest([self._segments(name, state.columns).append(state)]))
        elif before.get("state"):
            parts["state"] = (before["state"]["columns"], Manifest(before["state"]["data"], before["state"]["bits"]))
        return self._commit(name, parts, before.get("head") if head is None else head)

    def width(self, name: str) -> int | None:
        """Width of the active version's vectors; None if it has none."""
        points = self.read(name)
        row = points.select(F.size("embedding").alias("n")).first() if "embedding" in points.columns else None
        return row.n if row else None

    def promote(self, name: str, version: int, keep: int = 2) -> None:
        """Make a version the active one; older ones go, but for the last ``keep``."""
        before = self.pointers(name)
        number = before[-1][0] + 1 if before else 1
        fs, where = self._fs(f"{self.root}/{name}/active-{number}-v{version}")
        fs.create(where, False).close()
        for old, v in before[:-1]:
            f, p = self._fs(f"{self.root}/{name}/active-{old}-v{v}")
            f.delete(p, False)
        stay = {version, *([before[-1][1]] if before else []), *self.versions(name)[-keep:]}
        for old in self.versions(name):
            if old < version and old not in stay:
                f, p = self._fs(self.path(name, old))
                f.delete(p, True)
        self._sweep(name)

    def _sweep(self, name: str) -> None:
        """Remove segments that no version names; a table has one writer at a time."""
        named = {d for v in self.versions(name) for part in ("points", "state") for m in [self._manifest(name, v).get(part) or {}] for d in [*m.get("data", []), *m.get("bits", [])]}
        fs, where = self._fs(f"{self.root}/{name}/data")
        for status in fs.listStatus(where) if fs.exists(where) else []:
            if status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)

    def upsert(self, name: str, points: DataFrame, width: int | None = None) -> int:
        if self.active(name) is None:
            version = self.build(name, last_of_each(points), width)
        else:
            version = self.change(name, points, width=width)
        self.promote(name, version)
        return version

    def delete_files(self, name: str, workspace: str, paths: DataFrame) -> int:
        version = self.change(name, gone=[lambda rows: of_files(rows, workspace, paths)])
        self.promote(name, version)
        return version

    def delete_directories(self, name: str, workspace: str, directories: Sequence[str]) -> int:
        here = lambda d: lambda rows: rows.filter((F.col("workspace_id") == workspace) & P.subtree(F.col(KEY), d))
        version = self.change(name, gone=[here(d) for d in directories])
        self.promote(name, version)
        return version

    def compact(self, name: str) -> int:
        """The active version's rows in one segment each, as a new active version."""
        manifest = self._manifest(name, self.active(name))
        parts = {}
        for part in ("points", "state"):
            if manifest.get(part):
                segments, old = self._part(name, part)
                parts[part] = (manifest[part]["columns"], segments.compacted(old))
        version = self._commit(name, parts, manifest.get("head"))
        self.promote(name, version)
        return version

    def drop(self, name: str) -> None:
        """Remove a table; one that is not there is no error."""
        fs, where = self._fs(f"{self.root}/{name}")
        fs.delete(where, True)

    def indexed_files(self, name: str) -> DataFrame:
        return self.read(name).select("file_path").distinct()

    def counts(self, names: Sequence[str]) -> dict[str, int]:
        return {n: self.read(n).count() for n in names if self.active(n) is not None}
