"""Source trees as a data source of Spark: a partition for each share of the directories, excluded ones never listed.

``spark.read.format("siltstone_tree")`` takes the options ``root``, ``excluded`` and ``below`` (JSON lists:
directories by name or by path below the root, and the paths to keep to), ``partitions``, and
``characters``: how much of each file is read, all of it unless said, none for 0. The driver lists
directories from the top until there are enough to deal; the tasks list the rest and open the files.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FOUND = "workspace_root string, file_path string, content string, size long, last_write_time_utc timestamp"
#: Rows and bytes of content that a task hands over at once.
BATCH_FILES = 256
BATCH_BYTES = 16 << 20
#: UTF-8 has no longer characters.
CHARACTER_BYTES = 4


class LocalFiles:
    """Listings and reads of a mounted file system; both are counted."""

    def __init__(self) -> None:
        self.listed: list[str] = []
        self.bytes_read = 0

    def children(self, directory: str) -> tuple[list[str], list[tuple[str, int, datetime]]]:
        """(directories, files with size and time) of a directory, by name; links to directories are not followed."""
        self.listed.append(directory)
        below, files = [], []
        try:
            entries = sorted(os.scandir(directory), key=lambda e: e.name)
        except (FileNotFoundError, NotADirectoryError, PermissionError):  # gone meanwhile, or not ours to see
            return [], []
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                below.append(e.path)
            elif e.is_file():
                s = e.stat()
                files.append((e.path, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC)))
        return below, files

    def read(self, path: str, limit: int | None) -> bytes:
        with open(path, "rb") as f:
            data = f.read() if limit is None else f.read(limit)
        self.bytes_read += len(data)
        return data


class RemoteFiles:
    """The same of a file system that pyarrow knows."""

    def __init__(self, root: str) -> None:
        self.listed: list[str] = []
        self.bytes_read = 0
        self.system, self.base = _remote(root)
        self.prefix = root[: len(root.rstrip("/")) - len(self.base.rstrip("/"))]

    def children(self, directory: str) -> tuple[list[str], list[tuple[str, int, datetime]]]:
        from pyarrow import fs

        self.listed.append(directory)
        found = self.system.get_file_info(fs.FileSelector(directory.removeprefix(self.prefix), allow_not_found=True))
        found.sort(key=lambda i: i.path)
        named = lambda i: self.prefix + i.path
        below = [named(i) for i in found if i.type == fs.FileType.Directory]
        return below, [(named(i), i.size, i.mtime) for i in found if i.type == fs.FileType.File]

    def read(self, path: str, limit: int | None) -> bytes:
        with self.system.open_input_file(path.removeprefix(self.prefix)) as f:
            data = f.read() if limit is None else f.read(limit)
        self.bytes_read += len(data)
        return data


def _remote(root: str):
    from pyarrow import fs

    scheme, _, rest = root.partition("://")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3', 'wasbs': 'abfss', 'wasb': 'abfs'}.get(scheme, scheme)}://{rest}")


def files_of(root: str) -> LocalFiles | RemoteFiles:
    parts = urlparse(root)
    return LocalFiles() if "://" not in root or parts.scheme == "file" else RemoteFiles(root)


def local_path(root: str) -> str:
    return unquote(urlparse(root).path) if root.startswith("file:") else root


def can_list(root: str) -> bool:
    """Whether this source reaches the root."""
    if "://" not in root or root.startswith("file:"):
        return True
    try:
        _remote(root)
    except Exception:  # noqa: BLE001  no such scheme, or its library is not here
        return False
    return True


@dataclass(frozen=True)
class Share(InputPartition):
    """What a task does: whole subtrees, and single files that the driver came across."""

    directories: list[str]
    files: list[tuple[str, int, datetime]]


@dataclass
class Walk:
    """Directories below a root without the excluded ones, and files."""

    root: str
    excluded: list[str] = field(default_factory=list)
    below: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.root = local_path(self.root).rstrip("/") or "/"
        self.files = files_of(self.root)
        self.names = {e.replace("\\", "/").strip("/").lower() for e in self.excluded}
        self.targets = [b.replace("\\", "/").rstrip("/").lower() for b in self.below]

    def enters(self, directory: str) -> bool:
        """Whether a directory is listed: nothing excludes it, and it leads to a target or lies in one."""
        path = directory.removeprefix(self.root).strip("/").lower()
        if path.rsplit("/", 1)[-1] in self.names or path in self.names:
            return False
        here = directory.lower()
        return not self.targets or any(t == here or here.startswith(t + "/") or t.startswith(here + "/") for t in self.targets)

    def takes(self, file: str) -> bool:
        here = file.lower()
        return not self.targets or any(here == t or here.startswith(t + "/") for t in self.targets)

    def step(self, directory: str) -> tuple[list[str], list[tuple[str, int, datetime]]]:
        """(directories to go on with, files) of one directory."""
        below, files = self.files.children(directory)
        return [d for d in below if self.enters(d)], [f for f in files if self.takes(f[0])]

    def shares(self, wanted: int) -> list[Share]:
        """The tree in about ``wanted`` shares, or fewer if it has not so many directories."""
        directories, files = [self.root], []
        while directories and len(directories) < wanted:
            deeper = []
            for d in directories:
                more, here = self.step(d)
                deeper += more
                files += here
            directories = deeper
        n = max(1, min(wanted, max(len(directories), -(-len(files) // BATCH_FILES))))
        return [Share(directories[k::n], files[k::n]) for k in range(n)]

    def all_of(self, share: Share) -> Iterator[tuple[str, int, datetime]]:
        yield from share.files
        open_ = list(reversed(share.directories))
        while open_:
            more, files = self.step(open_.pop())
            yield from files
            open_ += reversed(more)

    def content(self, path: str, characters: int | None) -> str | None:
        """The file's text, bytes that are no UTF-8 replaced; its first ``characters`` only if said; None for 0."""
        if characters == 0:
            return None
        text = self.files.read(path, None if characters is None else characters * CHARACTER_BYTES).decode("utf-8", "replace")
        return text if characters is None else text[:characters]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.walk = lambda: Walk(options["root"], json.loads(options.get("excluded", "[]")), json.loads(options.get("below", "[]")))
        self.root, self.wanted = options["root"], int(options.get("partitions", 8))
        self.characters = int(options["characters"]) if "characters" in options else None

    def partitions(self) -> list[InputPartition]:
        return self.walk().shares(self.wanted)

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        walk, rows, held = self.walk(), [], 0
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC")]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])
        for path, size, modified in walk.all_of(partition):
            try:
                text = walk.content(path, self.characters)
            except FileNotFoundError:  # gone since it was listed
                continue
            rows.append((self.root, path, text, size, modified))
            held += len(text or "")
            if len(rows) >= BATCH_FILES or held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltstone_tree"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))
