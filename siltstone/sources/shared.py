"""Folders that the driver and all executors reach, for tables that a job writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; it goes when the driver ends.

    Where that is unset, a local session gets a temporary folder and a cluster an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    made = f"{base.rstrip('/')}/siltstone/{label}-{uuid.uuid4().hex}"
    _made.append((spark, made))
    return made


@atexit.register
def clear() -> None:
    """Remove all folders so far."""
    for spark, path in _made:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
            pass
    _made.clear()
