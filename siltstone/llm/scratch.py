"""Written tables in the shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster gets an error,
    since a folder of one machine is out of the others' reach.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_made: dict[str, Scratch] = {}


def clear() -> None:
    """Remove the tables of all calls so far; what they returned must have been used or written by then."""
    for scratch in list(_made.values()):
        scratch._remove(scratch.base)
    _made.clear()


class Scratch:
    """A folder of one operator call; its tables go when the driver ends, or with ``drop`` or ``clear``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/siltstone/{label}-{uuid.uuid4().hex}"
        _made[self.base] = self

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again with the same schema."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._remove(self.path(name))

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
            pass


atexit.register(clear)
