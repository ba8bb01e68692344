"""Scans of changed files only: each new, renamed or rewritten file once, repeats nothing."""

import os
import time

import pytest

from riskloom.plans import jobs
from riskloom.sources.versioned import VersionedTable
from riskloom.streaming import jobs as streams

RISKY = "def run(x):\n    os.system(x)\n"
SAFE = "def add(a, b):\n    return a + b\n"


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return path


def scanned(spark, output):
    """(version, file) of every scan written."""
    found = spark.read.option("basePath", output).parquet(f"{output}/scan=*")
    return sorted((r[0], r[1]) for r in found.select("scan", "filename").distinct().collect())


def test_each_change_is_scanned_once(spark, tmp_path):
    root, state, output = tmp_path / "src", str(tmp_path / "state"), str(tmp_path / "out")
    put(root, "a.py", RISKY), put(root, "sub/b.py", SAFE), put(root, "notes.txt", RISKY), put(root, "e.py", "")

    def step():
        done = jobs.scan_changes(spark, str(root), state, output, buckets=4)
        return done["changed"], done["touched"], done["gone"]

    assert step() == (3, 0, 0)
    assert scanned(spark, output) == [(1, "a.py"), (1, "sub/b.py")]
    assert step() == (0, 0, 0) and VersionedTable.open(spark, state).version == 1
    os.utime(root / "a.py", (1, 1))                       # touched: other stamp, same bytes
    put(root, "sub/b.py", SAFE.replace("a + b", "eval(a)"))  # rewritten
    assert step() == (1, 1, 0) and step() == (0, 0, 0)
    os.rename(root / "a.py", root / "c.py")               # renamed: a new name, and one gone
    assert step() == (1, 0, 1)
    put(root, "sub/b.py", "")                             # nothing is left to find in it
    assert step() == (1, 0, 0) and step() == (0, 0, 0)
    assert scanned(spark, output) == [(1, "a.py"), (1, "sub/b.py"), (2, "sub/b.py"), (3, "c.py")]
    now = jobs.current_findings(spark, state, output)
    whole = jobs.scan_corpus(spark, str(root))["findings"]
    columns = ["filename", "function_name", "is_vulnerable", "cwe"]
    columns = [c for c in columns if c in whole.columns]
    assert sorted(map(tuple, now.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))


def test_a_failed_scan_is_repeated_whole(spark, tmp_path, monkeypatch):
    root, state, output = tmp_path / "src", str(tmp_path / "state"), str(tmp_path / "out")
    put(root, "a.py", RISKY)

    def lost(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(VersionedTable, "upsert", lost)
        with pytest.raises(RuntimeError):
            jobs.scan_changes(spark, str(root), state, output)
    assert jobs.scan_changes(spark, str(root), state, output)["changed"] == 1
    assert scanned(spark, output) == [(1, "a.py")]
    with pytest.raises(FileNotFoundError):
        jobs.scan_changes(spark, str(tmp_path / "nowhere"), state, output)


def test_watched_tree(spark, tmp_path):
    root, state, output = tmp_path / "src", str(tmp_path / "state"), str(tmp_path / "out")
    put(root, "a.py", RISKY)
    for n, name in enumerate(["a.py", "b.py"]):          # the second run is a restart
        put(root, name, RISKY)
        query = streams.watch_tree(spark, str(root), state, output, every="1 second").start()
        until = time.time() + 90
        while time.time() < until and query.exception() is None and not (
                VersionedTable.exists(spark, state) and VersionedTable.open(spark, state).version > n):
            time.sleep(0.5)
        query.stop()
        assert query.exception() is None
    assert {f for _, f in scanned(spark, output)} == {"a.py", "b.py"}
