"""WARC archives with a Zstandard dictionary in front and every record its own frame.

A file ``*.warc.zst`` starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
itself compressed; each record after it is one frame that the dictionary compresses, so a reader
can start at any record. The dictionary is trained on records of the archived pages: a bounded
sample of about ``SAMPLE_ROWS`` rows (twice that at most) by a hash of their ids, and no more than
``SAMPLE_BYTES`` of each; it sets the size of the files and nothing else. A task starts another archive when one has
``ARCHIVE_BYTES``.

Of pages with equal payloads the one with the largest id is a ``response`` record, and the others
are ``revisit`` records that name it and carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import ExitStack
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import files
from siltstone.llm.scratch import Scratch

if TYPE_CHECKING:
    import pyarrow as pa

# fixed values of the formats
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_ROWS = 1000
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 1 << 30
#: A reader copies what is left of its buffer once a record.
READ_BYTES = 16 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
MANIFEST = "uri string, records long, file_bytes long"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, "
    "payload_bytes long, payload binary"
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the format's own digest


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC 1.1 record; white space in a URL is percent-encoded, as headers are lines."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if kind == "revisit" else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of RECORDS; checks a response's length and digest against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    urn = lambda v: int(v) if (v := v.removeprefix("<urn:page:").removesuffix(">")) else None
    body = rest[: int(fields["Content-Length"])]
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(fields["WARC-Payload-Length"])
    if fields["WARC-Type"] == "response" and (len(body) != length or digest(body) != sha1):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": urn(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": urn(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload_digest": sha1,
        "payload_bytes": length,
        "payload": body if fields["WARC-Type"] == "response" else None,
    }


def train_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary of the records; too few to train on serve as one as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


def dictionary_frame(dictionary: bytes) -> bytes:
    import zstandard

    inside = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return SKIPPABLE_MAGIC.to_bytes(4, "little") + len(inside).to_bytes(4, "little") + inside


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


def read_dictionary(f) -> bytes:
    """The dictionary from the head of an archive; leaves the file at the first record."""
    import zstandard

    magic, size = int.from_bytes(f.read(4), "little"), int.from_bytes(f.read(4), "little")
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive has no dictionary frame in front")
    inside = f.read(size)
    return zstandard.ZstdDecompressor().decompress(inside) if inside.startswith(ZSTD_MAGIC) else inside


def read_archive(f) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    raw = read_dictionary(f)
    decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)) if raw else zstandard.ZstdDecompressor()
    rest = b""
    while rest or (rest := f.read(READ_BYTES)):
        one = decompress.decompressobj()
        out = [one.decompress(rest)]
        while not one.eof:
            more = f.read(READ_BYTES)
            if not more:
                raise ValueError("the archive ends inside a record")
            out.append(one.decompress(more))
        rest = one.unused_data
        yield b"".join(out)


def classify(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html and ``keeper``: the page that holds the payload; null for one of its own.

    Only payload hashes meet in the grouping; what repeats is joined back, and a payload that a
    third of the pages share stays on the side of the join that can be split.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("_sha", F.sha2(html, 256))
    many = (
        hashed.filter(F.octet_length(html) >= min_bytes)
        .groupBy("_sha")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("_sha", "keeper")
    )
    return hashed.join(many, "_sha", "left").drop("_sha")


def _add(done: dict[str, list], uri: str, records: int, size: int) -> None:
    for column, value in zip(done.values(), (uri, records, size), strict=True):
        column.append(value)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder``, one a partition or more; their manifest.

    A null html is an empty payload. Rows with equal ids and payloads are all responses where
    theirs is the largest id; rows with a null id are responses. Names hold the task attempt, and
    only files in the manifest count.
    """
    some = pages.filter("html IS NOT NULL AND html <> ''")
    n = max(1, some.count())
    # about SAMPLE_ROWS rows by a hash of the id, so that no task sends the driver more than its share
    near = F.pmod(F.xxhash64("page_id"), F.lit(n)) < SAMPLE_ROWS
    cut = F.substring("html", 1, SAMPLE_BYTES).alias("html")
    # in order, so that equal tables give equal dictionaries
    sample = some.filter(near).select("page_id", "url", cut).orderBy(F.xxhash64("page_id"), "page_id", "url", "html")
    rows = sample.limit(2 * SAMPLE_ROWS).collect()
    raw = train_dictionary([record(r.page_id, r.url, "response", None, r.html.encode()) for r in rows]) if rows else b""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw) if raw else None, write_content_size=True)
        done: dict[str, list] = {"uri": [], "records": [], "file_bytes": []}
        n = size = 0
        with ExitStack() as opened:
            out = None
            for batch in batches:
                for page_id, url, html, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        uri = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done['uri'])}.warc.zst"
                        out = opened.enter_context(files.writer(uri))
                        n, size = 0, out.write(dictionary_frame(raw))
                    again = keeper is not None and page_id is not None and page_id != keeper
                    made = record(page_id, url, "revisit" if again else "response", keeper, (html or "").encode())
                    size += out.write(compress.compress(made))
                    n += 1
                    if size >= archive_bytes:
                        opened.close()
                        out = _add(done, uri, n, size)
            if out is not None:
                opened.close()
                _add(done, uri, n, size)
        if done["uri"]:
            yield pa.RecordBatch.from_pydict(done)

    rows = classify(pages, min_bytes).select("page_id", "url", "html", "keeper")
    return rows.mapInArrow(write, MANIFEST)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files that ``manifest`` names; see RECORDS. A revisit's payload is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        schema = pa.schema(list(zip(names, types, strict=True)))
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.reader(uri) as f:
                    for raw in read_archive(f):
                        row = parse_record(raw)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("uri").repartition(n, "uri").mapInArrow(read, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """Write ``pages`` as archives; the manifest, and the records read back from them.

    An empty table writes no archive and reads no record. Other columns are left out.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.table(write_archives(pages, folder or scratch.path("archives"), min_bytes), "manifest")
    return manifest, read_archives(manifest, payloads)
