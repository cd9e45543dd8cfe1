"""One writer at a time across machines: leases as files of a shared folder, with fencing numbers.

A lease is a file ``lease-<number>``, made only if no such file is there, which one of two writers
alone can do. It holds until the time in it or in its last ``beat-<number>-<k>``; ``done-<number>``
gives it back. Who comes after an expired lease takes the next number; the writer before then fails at
its next step (``check``), as its number is no longer the last one. Clocks of the machines may differ
by less than ``SLACK``.
"""

from __future__ import annotations

import json
import re
import socket
import threading
import time
import uuid

from pyspark.sql import SparkSession

TTL = 600.0
SLACK = 30.0


class Busy(RuntimeError):
    """Another writer has the lease, or has taken it over."""


class Lease:
    """``with Lease(spark, folder) as lease:`` holds it, and beats in the background until the end."""

    def __init__(self, spark: SparkSession, folder: str, ttl: float = TTL, owner: str | None = None):
        self.spark, self.folder, self.ttl = spark, folder.rstrip("/"), ttl
        self.owner = owner or f"{socket.gethostname()}-{uuid.uuid4().hex}"
        self.number: int | None = None
        self._beats, self._stop = 0, threading.Event()

    def _fs(self, name: str = ""):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self) -> list[str]:
        fs, where = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _write(self, name: str, told: dict) -> bool:
        """Make a file; False if it is there already."""
        fs, where = self._fs(name)
        try:
            out = fs.create(where, False)
        except Exception:
            if fs.exists(where):
                return False
            raise
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        return True

    def _until(self, name: str) -> float:
        """When the lease or beat of that name ends; a file that is still being written counts from now."""
        fs, where = self._fs(name)
        stream = fs.open(where)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)["until"] if text else time.time() + self.ttl

    @staticmethod
    def _last(names: list[str]) -> int:
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"lease-(\d+)", n))), default=0)

    def acquire(self) -> int:
        names = self._names()
        last = self._last(names)
        if last and f"done-{last}" not in names:
            beats = sorted((n for n in names if n.startswith(f"beat-{last}-")), key=lambda n: int(n.rsplit("-", 1)[1]))
            if time.time() < self._until(beats[-1] if beats else f"lease-{last}") + SLACK:
                raise Busy(f"another writer holds {self.folder}")
        if not self._write(f"lease-{last + 1}", {"owner": self.owner, "until": time.time() + self.ttl}):
            raise Busy(f"another writer has just taken {self.folder}")
        self.number = last + 1
        for n in names:  # what came before tells nothing any more
            if (m := re.fullmatch(r"\w+-(\d+)(-\d+)?", n)) and int(m[1]) < last:
                fs, where = self._fs(n)
                fs.delete(where, False)
        return self.number

    def check(self) -> None:
        """Raise if another writer has taken over."""
        if self.number is None or self._last(self._names()) != self.number:
            raise Busy(f"another writer has taken {self.folder} over")

    def beat(self) -> None:
        self.check()
        self._beats += 1
        self._write(f"beat-{self.number}-{self._beats}", {"until": time.time() + self.ttl})
        if self._beats > 1:
            fs, where = self._fs(f"beat-{self.number}-{self._beats - 1}")
            fs.delete(where, False)

    def release(self) -> None:
        self._stop.set()
        if self.number is not None:
            self._write(f"done-{self.number}", {})
            self.number = None

    def _beating(self) -> None:
        while not self._stop.wait(self.ttl / 3):
            try:
                self.beat()
            except Exception:  # noqa: BLE001  taken over, or the store is away: the next check says so
                if self.number is None:
                    return

    def __enter__(self) -> Lease:
        self.acquire()
        threading.Thread(target=self._beating, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.release()
