"""A table as immutable segments with deletion bitmaps, so that a change writes what it changes.

A state of the table is a manifest: the folders of its data and those of its bitmaps. Rows are known
by their file and their place there, which Spark's reader gives; a bitmap holds the dead places of
32,768 rows of one file. A change writes a data folder with the new rows and a bitmap folder with the
places of the rows that it replaces, and lists both in a new manifest; no file is ever changed, so who
reads by an older manifest still sees its state. Bitmaps of one file are united when they are read.

Data is sorted by a key, so that a range of keys is a range of rows, which the least and greatest
values of row groups rule out; below a directory is such a range (``paths.subtree``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bitmap, as in Spark's own bitmap functions.
BITMAP_ROWS = 32_768
#: More folders than this, or more bytes of bitmaps, and the next change writes the table anew.
MOST_FOLDERS = 24
MOST_BITMAP_BYTES = 64 << 20
_FILE, _ROW, KEY = "_file", "_row", "_key"


@dataclass(frozen=True)
class Manifest:
    data: list[str] = field(default_factory=list)
    bits: list[str] = field(default_factory=list)

    @property
    def folders(self) -> list[str]:
        return [*self.data, *self.bits]


class Segments:
    """Segments of one table under a folder."""

    def __init__(self, spark: SparkSession, folder: str, key: Callable[[], Column]):
        """``key`` orders the rows; it is a column of theirs, so two rows of one key may differ."""
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _bytes(self, folder: str) -> int:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{folder}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def written(self, manifest: Manifest) -> int:
        """Bytes of a state's files."""
        return sum(map(self._bytes, manifest.folders))

    def append(self, rows: DataFrame, kind: str = "data") -> str:
        """Write rows as a new data folder, ordered by key; its name."""
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.withColumn(KEY, self.key()).repartitionByRange(KEY).sortWithinPartitions(KEY).write.parquet(f"{self.folder}/{name}")
        return name

    def live(self, manifest: Manifest, where: Callable[[Column], Column] | None = None) -> DataFrame:
        """Rows that no bitmap names, with their key, file and place; ``where`` is a condition on the key."""
        folders = [f"{self.folder}/{d}" for d in manifest.data]
        rows = self.spark.read.parquet(*folders).select("*", F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
        if where is not None:
            rows = rows.filter(where(F.col(KEY)))
        if not manifest.bits:
            return rows
        bits = self.spark.read.parquet(*[f"{self.folder}/{b}" for b in manifest.bits]).groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        # a change that would make them more than MOST_BITMAP_BYTES writes the table anew
        dead = F.broadcast(bits)
        joined = rows.join(dead, (rows[_FILE] == dead["file"]) & (F.expr(f"{_ROW} div {BITMAP_ROWS}") == dead["bucket"]), "left")
        place = F.col(_ROW) % BITMAP_ROWS
        byte = F.conv(F.hex(F.substr("bits", F.expr(f"CAST({_ROW} % {BITMAP_ROWS} div 8 + 1 AS INT)"), F.lit(1))), 16, 10).cast("long")
        return joined.filter(F.col("bits").isNull() | (F.getbit(byte, (place % 8).cast("int")) == 0)).drop("file", "bucket", "bits")

    def read(self, manifest: Manifest, where: Callable[[Column], Column] | None = None) -> DataFrame:
        return self.live(manifest, where).drop(KEY, _FILE, _ROW)

    def bury(self, dead: DataFrame) -> str | None:
        """Write bitmaps of rows of ``live``; their folder, or None if there are no rows."""
        place = (F.col(_ROW) % BITMAP_ROWS).alias("place")
        rows = dead.select(F.col(_FILE).alias("file"), F.expr(f"{_ROW} div {BITMAP_ROWS}").alias("bucket"), place)
        name = f"bits-{uuid.uuid4().hex}"
        rows.groupBy("file", "bucket").agg(F.bitmap_construct_agg("place").alias("bits")).write.parquet(f"{self.folder}/{name}")
        return name if not self.spark.read.parquet(f"{self.folder}/{name}").isEmpty() else None

    def worn(self, manifest: Manifest) -> bool:
        """Whether the table should be written anew."""
        return len(manifest.folders) > MOST_FOLDERS or sum(map(self._bytes, manifest.bits)) > MOST_BITMAP_BYTES

    def changed(self, manifest: Manifest, new: DataFrame | None, dead: DataFrame | None) -> Manifest:
        """The state after ``dead`` rows of ``live`` have gone and ``new`` ones have come."""
        bits = self.bury(dead) if dead is not None else None
        data = self.append(new) if new is not None else None
        after = Manifest([*manifest.data, *([data] if data else [])], [*manifest.bits, *([bits] if bits else [])])
        return self.compacted(after) if self.worn(after) else after

    def compacted(self, manifest: Manifest) -> Manifest:
        """The same rows in one folder."""
        return Manifest([self.append(self.read(manifest))])
