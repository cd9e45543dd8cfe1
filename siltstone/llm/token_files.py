"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

Rows are dealt by ranges of the document id, and of the text's hash where ids are equal, and sorted
within each, so that part k's ids all come before part k+1's and no id is too frequent for one part. A task writes two files: ``<part>.bin``, its documents' ids one after another
in the unsigned type that the vocabulary needs (16 or 32 bits, little-endian), and ``<part>.idx``:
a header (magic, version, bytes per id, documents), the document ids as signed 64-bit integers,
and the offsets, one more than documents, as unsigned 64-bit counts of ids from the part's start.
A part's base, the ids before it, is a prefix sum over the manifest, a row for each part. Names
hold the task attempt, and only files that the manifest names are read: a retried or doubled task
leaves a file that nobody looks at.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from contextlib import ExitStack
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import files
from siltstone.llm.scratch import Scratch
from siltstone.llm.tokens import BYTE_LEVEL, encoded, end_token

if TYPE_CHECKING:
    import pyarrow as pa

MAGIC = b"SLTTOKID"
HEADER = "<8sIIQ"  # magic, version, bytes per id, documents
VERSION = 1
FLUSH_BYTES = 8 << 20
MANIFEST = "part int, base_uri string, n_docs long, n_ids long, id_bytes int"
READ_DOCS = 4096
#: Text a part holds, in bytes; more parts than shuffle partitions are made where that needs them.
PART_BYTES = 256 << 20


class PartWriter:
    """One part's two files."""

    def __init__(self, uri: str, id_bytes: int):
        self.uri, self.id_bytes = uri, id_bytes
        self.docs, self.sizes = array("q"), array("q")  # 16 bytes a document

    def write(self, out, doc_ids: list[int], ids: list[bytes]) -> None:
        import numpy as np

        self.docs.extend(doc_ids)
        self.sizes.extend(len(x) // 4 for x in ids)
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        out.write(flat.astype(f"<u{self.id_bytes}").tobytes())

    def finish(self) -> int:
        import numpy as np

        offsets = np.zeros(len(self.sizes) + 1, dtype="<u8")
        np.cumsum(np.frombuffer(self.sizes, dtype=np.int64), out=offsets[1:])
        with files.writer(f"{self.uri}.idx") as f:
            f.write(struct.pack(HEADER, MAGIC, VERSION, self.id_bytes, len(self.docs)))
            f.write(np.frombuffer(self.docs, dtype=np.int64).astype("<i8").tobytes())
            f.write(offsets.tobytes())
        return int(offsets[-1])


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int,
    vocabulary_size: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int | None = None,
) -> DataFrame:
    """Write ``docs`` under ``folder``; the manifest, a row for each part.

    Null ids come first and are written as the smallest integer; a null text has the end id only.
    Rows with equal ids stand next to each other, in order of their texts' hashes. No rows: no parts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = parts or parts_for(rows)
    id_bytes = 2 if max(vocabulary_size, end_id + 1) <= 1 << 16 else 4
    end = end_token(end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        uri = f"{folder}/part-{part:06d}-{task.taskAttemptId()}"
        made, smallest = PartWriter(uri, id_bytes), -(2**63)
        out = None
        with ExitStack() as opened:
            for ids, found in encoded(batches, vocabulary, BYTE_LEVEL, end):
                if out is None:  # a part without rows has no files
                    out = opened.enter_context(files.writer(f"{uri}.bin"))
                made.write(out, [smallest if x is None else x for x in ids], found)
        if made.docs:
            n_ids = made.finish()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "base_uri": [uri], "n_docs": [len(made.docs)], "n_ids": [n_ids], "id_bytes": [id_bytes]},
                schema=pa.schema(
                    [("part", pa.int32()), ("base_uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("id_bytes", pa.int32())]
                ),
            )

    keyed = rows.withColumn("_hash", F.xxhash64("text"))
    order = ["doc_id", "_hash", "text"]
    return keyed.repartitionByRange(n, "doc_id", "_hash").sortWithinPartitions(*order).drop("_hash").mapInArrow(write, MANIFEST)


def parts_for(rows: DataFrame) -> int:
    """As many parts as there are shuffle partitions, or more where texts are over ``PART_BYTES`` for each."""
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // PART_BYTES))


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: ids of all parts before. It has a row for each part, so one task does."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files that ``manifest`` (with bases) names: doc_id, start, ids.

    ``ids`` are little-endian unsigned 32-bit bytes; a null id is given back as null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                idx, flat = files.Bytes(f"{row['base_uri']}.idx"), files.Bytes(f"{row['base_uri']}.bin")
                head = struct.calcsize(HEADER)
                magic, version, width, n = struct.unpack(HEADER, idx(0, head).tobytes())
                if magic != MAGIC or version != VERSION:
                    raise ValueError(f"{row['base_uri']}.idx is no token index")
                docs = idx(head, head + 8 * n).view("<i8")
                offsets = idx(head + 8 * n, head + 16 * n + 8).view("<u8").astype(np.int64)
                at = 0
                while at < n:  # a bounded slice of the mapped ids at a time
                    upto = int(np.searchsorted(offsets, offsets[at] + (FLUSH_BYTES // 4), side="right")) - 1
                    upto = min(n, max(at + 1, upto), at + READ_DOCS)
                    here = flat(int(offsets[at]) * width, int(offsets[upto]) * width)
                    some = here.view(f"<u{width}").astype("<u4").tobytes()
                    lo = (offsets[at:upto] - offsets[at]) * 4
                    hi = (offsets[at + 1 : upto + 1] - offsets[at]) * 4
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(docs[at:upto].astype(np.int64), mask=docs[at:upto] == -(2**63)),
                            "start": pa.array(offsets[at:upto] + row["base"]),
                            "ids": pa.array([some[a:b] for a, b in zip(lo, hi, strict=True)], type=pa.binary()),
                        }
                    )
                    at = upto
                idx.close()
                flat.close()

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = manifest.repartition(n, "part")
    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def token_files(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    vocabulary_size: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` as token files; the manifest with bases, and the documents read back from them."""
    scratch = Scratch(docs.sparkSession, "tokens")
    written = write_token_files(docs, folder or scratch.path("files"), vocabulary, end_id, vocabulary_size, id_col, text_col)
    manifest = with_bases(scratch.table(written, "manifest"))
    return manifest, read_token_files(manifest)
