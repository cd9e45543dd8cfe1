"""Media columns: texts stored as lossless WebP images and read back as pixel arrays.

The payload, a text's UTF-8 bytes padded with spaces to a positive multiple of 192, fills rows of
64 pixels with red, green and blue samples. A payload of over ``TILE_ROWS`` rows becomes several
files, one after another, so that memory does not grow with the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch
from siltstone.llm.webp_batch import decode_many, encode_rows

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

UNIT = 192
ROW_PIXELS = 64
TILE_ROWS = 256
BATCH_BYTES = 1 << 20
#: Files that are read side by side; a step costs much the same for many images as for few.
READ_BYTES = 12 << 20


def payload(text: str | None) -> tuple[int, bytes]:
    """(unpadded bytes, padded payload)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbours of up to ``most`` bytes together, or one that is larger by itself, as (first, end)."""
    first = held = 0
    for k, n in enumerate(sizes):
        if k > first and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if sizes:
        yield first, len(sizes)


def to_media(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload: one WebP file or several."""
    wide = UNIT * TILE_ROWS
    tiles = [p[at : at + wide] for p in payloads for at in range(0, len(p), wide)]
    files: list[bytes] = []
    for a, b in slices([len(t) for t in tiles], BATCH_BYTES):
        files += encode_rows(tiles[a:b], ROW_PIXELS)
    out, at = [], 0
    for p in payloads:
        n = -(-len(p) // wide)
        out.append(b"".join(files[at : at + n]))
        at += n
    return out


def split_files(media: bytes) -> list[bytes]:
    """The files of a stored form, by the sizes in their heads."""
    files, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] != b"RIFF" or end > len(media):
            raise ValueError("no WebP files")
        files.append(media[at:end])
        at = end
    return files


def from_media(stored: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, samples as rows of red, green, blue) of each stored form."""
    import numpy as np

    parts = [split_files(m) for m in stored]
    files = [f for p in parts for f in p]
    shapes, samples = [], []
    for a, b in slices([len(f) for f in files], READ_BYTES):
        for width, height, argb in decode_many(files[a:b]):
            shapes.append((width, height))
            samples.append(argb.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1])
    out, at = [], 0
    for p in parts:
        here = samples[at : at + len(p)]
        out.append((shapes[at][0], sum(h for _, h in shapes[at : at + len(p)]), here[0] if len(here) == 1 else np.concatenate(here)))
        at += len(p)
    return out


def feature(width: int, height: int, samples: np.ndarray) -> str:
    """Size, and by channel the sum, the sum of squares and an eight-bin histogram of the samples."""
    import numpy as np

    values = np.arange(256)
    parts = [f"{width}x{height}"]
    for k, name in enumerate("rgb"):
        counts = np.bincount(samples[:, k], minlength=256)
        bins = ",".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))
        parts.append(f"{name}={int(counts @ values)},{int(counts @ values**2)};{bins}")
    return "|".join(parts)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) written in the shared folder and read from there.

    A null text is an empty one; null and repeated ids stay; equal texts give equal files; other
    columns are left out; an empty table gives no rows.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices([3 * len(t) if (t := x.as_py()) else 0 for x in texts], 4 * BATCH_BYTES):
                found = [payload(t) for t in texts.slice(a, b - a).to_pylist()]
                made = to_media([data for _, data in found])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([n for n, _ in found], pa.int64()), pa.array(made, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = rows.mapInArrow(store, "doc_id long, n_bytes long, media binary")
    return Scratch(docs.sparkSession, "media").table(stored, "media")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def media_features(stored: DataFrame) -> DataFrame:
    """``stored`` with payload_bytes, payload_sha256, tail_crc32 and feature of what its files hold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "media", *(c.split()[0] for c in FEATURES.split(", "))]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for a, b in slices([len(m.as_buffer()) for m in batch.column(2)], READ_BYTES):
                some = batch.slice(a, b - a)
                rows = []
                for width, height, samples in from_media(some.column(2).to_pylist()):
                    data = samples.tobytes()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), feature(width, height, samples)))
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, *made], names=names)

    return stored.mapInArrow(read, f"doc_id long, n_bytes long, media binary, {FEATURES}")
