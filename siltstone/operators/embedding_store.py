"""Vectors by content, kept across runs and workspaces, so that no text is embedded twice by one model.

A model's vectors are rows of a content's hash and its vector, in folders that runs add and nobody
changes, each sorted by hash. Two runs may add the same content; the rows say the same, and one is
taken. Contents that are asked for meet them in a join on the hash, in front of which Spark puts a
Bloom filter of the asked hashes where the kept ones are many.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = "content_hash string, embedding array<float>"


class EmbeddingStore:
    def __init__(self, spark: SparkSession, folder: str, model: str, width: int | None):
        self.spark = spark
        self.folder = f"{folder.rstrip('/')}/{hashlib.sha256(f'{model}|{width}'.encode()).hexdigest()[:16]}"

    def _folders(self) -> list[str]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(str(p) for p in found if fs.exists(done(p, "_SUCCESS")))

    def kept(self) -> DataFrame:
        """All rows of runs that were added to their end."""
        folders = self._folders()
        return self.spark.read.schema(KEPT).parquet(*folders) if folders else self.spark.createDataFrame([], KEPT)

    def of(self, hashes: DataFrame) -> DataFrame:
        """A row for each of the hashes (content_hash) that is kept."""
        return self.kept().join(hashes.select("content_hash"), "content_hash", "left_semi").dropDuplicates(["content_hash"])

    def add(self, rows: DataFrame) -> None:
        """Keep vectors (content_hash, embedding) that are not there yet."""
        new = rows.filter("embedding IS NOT NULL").select("content_hash", "embedding").dropDuplicates(["content_hash"])
        missing = new.join(self.kept().select("content_hash"), "content_hash", "left_anti")
        missing.sortWithinPartitions("content_hash").write.parquet(f"{self.folder}/{uuid.uuid4().hex}")

    def compact(self) -> None:
        """All rows in one folder."""
        old = self._folders()
        if len(old) > 1:
            rows = self.spark.read.schema(KEPT).parquet(*old).dropDuplicates(["content_hash"])
            rows.sortWithinPartitions("content_hash").write.parquet(f"{self.folder}/{uuid.uuid4().hex}")
            for f in old:
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
