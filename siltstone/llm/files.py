"""Files that executors write to and read from a shared folder, whatever its scheme."""

from __future__ import annotations

import os
from contextlib import contextmanager
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


#: Names that Hadoop has for schemes that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def remote(uri: str):
    """pyarrow's file system of ``uri``, and the path there."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def ensure_dir(uri: str) -> None:
    if (path := _local(uri)) is not None:
        os.makedirs(path, exist_ok=True)
    else:
        system, path = remote(uri)
        system.create_dir(path, recursive=True)


@contextmanager
def writer(uri: str):
    """A binary file to write; names must be of one task attempt, so that no two attempts share one."""
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            yield f
    else:
        system, path = remote(uri)
        with system.open_output_stream(path) as f:
            yield f


@contextmanager
def reader(uri: str):
    """A binary file to read, with seek."""
    if (path := _local(uri)) is not None:
        with open(path, "rb") as f:
            yield f
    else:
        system, path = remote(uri)
        with system.open_input_file(path) as f:
            yield f


class Bytes:
    """A file's bytes by slices: mapped where the file is on a mounted file system, else read range by range."""

    def __init__(self, uri: str):
        import numpy as np

        self.mapped = self.file = None
        if (path := _local(uri)) is None:
            system, there = remote(uri)
            self.file = system.open_input_file(there)
        elif os.path.getsize(path):
            self.mapped = np.memmap(path, dtype=np.uint8, mode="r")
        else:
            self.mapped = np.empty(0, np.uint8)

    def __call__(self, start: int, stop: int):
        """Bytes ``start`` to ``stop`` as an array."""
        import numpy as np

        if self.file is None:
            return self.mapped[start:stop]
        return np.frombuffer(self.file.read_at(stop - start, start), dtype=np.uint8)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
