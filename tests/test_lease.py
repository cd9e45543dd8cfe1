"""Leases: one writer at a time, takeover after the end, and fencing."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

from siltstone.engine import Engine
from siltstone.operators import lease
from siltstone.operators.lease import Busy, Lease


def test_one_at_a_time(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/leases"
    with Lease(spark, folder) as first:
        assert first.number == 1
        with pytest.raises(Busy, match="holds"):
            Lease(spark, folder).acquire()
        first.check()
    with Lease(spark, folder) as second:
        assert second.number == 2
    # two that see the same state: one makes the file
    a, b = Lease(spark, folder), Lease(spark, folder)
    names = a._names()
    monkeypatch.setattr(b, "_names", lambda: names)
    a.acquire()
    with pytest.raises(Busy, match="just taken"):
        b.acquire()


def test_takeover_fences_the_one_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lease, "SLACK", 0.0)
    slow = Lease(spark, f"{tmp_path}/leases", ttl=0.2)
    slow.acquire()
    slow.beat()
    slow.beat()
    time.sleep(0.3)
    other = Lease(spark, f"{tmp_path}/leases")
    assert other.acquire() == 2
    with pytest.raises(Busy, match="taken"):
        slow.check()
    with pytest.raises(Busy):
        slow.beat()
    other.check()
    beating = Lease(spark, f"{tmp_path}/more", ttl=0.6)
    with beating:
        time.sleep(1.5)
        with pytest.raises(Busy):
            Lease(spark, f"{tmp_path}/more").acquire()


def test_an_index_run_needs_the_lease(spark, tmp_path, monkeypatch):
    ws = tmp_path / "ws"
    ws.mkdir()
    (ws / "a.md").write_text("# A\n")
    e = Engine(spark, f"{tmp_path}/store")
    held = e.lease(str(ws))
    held.acquire()
    with pytest.raises(Busy):
        e.index_workspace(str(ws))
    held.release()
    name = e.index_workspace(str(ws)).collection_name
    before = e.vectors.active(name)
    (ws / "a.md").write_text("# B\n")
    # another takes over while the run is busy: its version does not become active
    real = Engine._embedded

    def late(self, *args):
        out = real(self, *args)
        thief = self.lease(str(ws))
        thief._write("lease-99", {"owner": "thief", "until": time.time() + 100})
        return out

    monkeypatch.setattr(Engine, "_embedded", late)
    with pytest.raises(Busy, match="over"):
        e.index_workspace(str(ws))
    assert e.vectors.active(name) == before


HOLDER = """
import sys, time
from siltstone.operators.lease import Lease
from siltstone.session import local_session
spark = local_session(1)
with Lease(spark, sys.argv[1]):
    print("held", flush=True)
    sys.stdin.readline()
"""


def test_two_processes(spark, tmp_path):
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    other = subprocess.Popen([sys.executable, "-c", HOLDER, f"{tmp_path}/leases"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, env=env)
    try:
        assert other.stdout.readline() == "held\n"
        with pytest.raises(Busy):
            Lease(spark, f"{tmp_path}/leases").acquire()
        other.communicate("\n", timeout=60)
        assert Lease(spark, f"{tmp_path}/leases").acquire() == 2
    finally:
        other.kill()
