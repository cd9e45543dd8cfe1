"""Small JSON files: file states of one workspace, local groups, and progress lines."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas as S

_SAVED = (
    "workspaceRoot string, embeddingModel string, schemaVersion string, savedAtUtc timestamp, isComplete boolean, "
    "files array<struct<file_path:string, fingerprint:string, size:bigint, last_write_time_utc:timestamp, chunk_count:int>>"
)


def write_state(state: DataFrame, folder: str, root: str, model: str, complete: bool = True) -> None:
    """A state as JSON lines of one record each 512 files, in no order; readers put them together."""
    files = F.struct("file_path", "fingerprint", "size", "last_write_time_utc", "chunk_count")
    page = F.pmod(F.xxhash64("file_path"), F.greatest(F.ceil(F.lit(state.count()) / 512), F.lit(1)))
    head = {"workspaceRoot": root, "embeddingModel": model, "schemaVersion": str(S.SCHEMA_VERSION), "isComplete": complete}
    rows = state.groupBy(page.alias("page")).agg(F.collect_list(files).alias("files")).drop("page")
    stamped = rows.withColumns({k: F.lit(v) for k, v in head.items()}).withColumn("savedAtUtc", F.lit(datetime.now(UTC).replace(tzinfo=None)))
    stamped.write.mode("overwrite").json(folder)


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """The file rows of a saved state; another schema version is an error."""
    saved = spark.read.schema(_SAVED).json(folder)
    for r in saved.select("schemaVersion").distinct().collect():
        S.check_schema_version(r.schemaVersion)
    return saved.select(F.explode("files").alias("f")).select("f.*")


def read_local_groups(spark: SparkSession, path: str) -> DataFrame:
    """Groups of a local JSON file, a list of records; a file that is not there has none."""
    place = Path(path)
    rows = json.loads(place.read_text(encoding="utf-8")) if place.exists() else []
    return spark.createDataFrame([(g["name"], "local", list(g.get("roots") or []), list(g.get("excludeDirectories") or []), False) for g in rows], S.GROUPS)


def write_local_group(path: str, name: str, roots: list[str], excludes: list[str] | None = None) -> None:
    """Add or replace a group, whatever the case of its name."""
    if not roots:
        raise ValueError("a group needs a root")
    place = Path(path)
    rows = json.loads(place.read_text(encoding="utf-8")) if place.exists() else []
    rows = [g for g in rows if g["name"].strip().lower() != name.strip().lower()]
    rows.append({"name": name.strip(), "roots": roots, "excludeDirectories": excludes or []})
    place.write_text(json.dumps(rows, indent=2), encoding="utf-8")


def delete_local_group(path: str, name: str) -> None:
    place = Path(path)
    if place.exists():
        rows = [g for g in json.loads(place.read_text(encoding="utf-8")) if g["name"].strip().lower() != name.strip().lower()]
        place.write_text(json.dumps(rows, indent=2), encoding="utf-8")


@dataclass(frozen=True)
class Progress:
    """A step of a run: stage, how far, of how much, and a message."""

    workspace_root: str
    stage: str
    current: int
    total: int | None
    message: str


def progress_lines(path: str) -> Callable[[Progress], None]:
    """A sink that adds each step as a JSON line."""

    def put(p: Progress) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(asdict(p)) + "\n")

    return put
