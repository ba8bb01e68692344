"""Which files of a source tree are new, changed or gone since they were last read."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from . import tree
from .versioned import VersionedTable

SEEN = "path string, stamp string, digest string, scanned int"
_LISTED = pa.schema([("path", pa.string()), ("stamp", pa.string())])
_READ = pa.schema([("path", pa.string()), ("stamp", pa.string()), ("digest", pa.string()),
                   ("content", pa.binary())])


def _stamp(found: os.stat_result) -> str:
    """Changes with any write; the inode's time also with a rename that keeps the other."""
    return f"{found.st_mtime_ns}-{found.st_ctime_ns}-{found.st_size}"


def list_stamps(spark: SparkSession, root: str) -> DataFrame:
    """(path, stamp) of every `.py` file below `root`, listed by the tasks."""
    base = os.path.abspath(root)
    if not os.path.isdir(base):
        raise FileNotFoundError(f"no such folder: {root}")

    def stamps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"path": [], "stamp": []}
            for path in batch.column(0).to_pylist():
                try:
                    rows["stamp"].append(_stamp(os.stat(os.path.join(base, path))))
                    rows["path"].append(path)
                except OSError:
                    continue
            yield pa.RecordBatch.from_pydict(rows, _LISTED)

    spark.dataSource.register(tree.SourceTree)
    wanted = max(64, 4 * spark.sparkContext.defaultParallelism)
    paths = spark.read.format("source_tree").option("partitions", wanted).load(base)
    return paths.repartition(wanted, "path").mapInArrow(stamps, "path string, stamp string")


def read_stamped(paths: DataFrame, root: str) -> DataFrame:
    """(path, stamp, digest, content); the stamp is that of the opened file, taken before it is read.

    A file that is written to meanwhile has another stamp at the next listing and is read again.
    Files that are gone or cannot be read are left out.
    """
    base = os.path.abspath(root)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)]
            return pa.RecordBatch.from_arrays(columns, schema=_READ)

        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(base, path), "rb") as file:
                        stamp = _stamp(os.fstat(file.fileno()))
                        blob = file.read()
                except OSError:
                    continue
                rows.append((path, stamp, hashlib.sha256(blob).hexdigest(), blob))
                size += len(blob)
                if size >= tree.BATCH_BYTES:
                    yield packed()
                    rows, size = [], 0
        if rows:
            yield packed()

    return paths.select("path").mapInArrow(contents, "path string, stamp string, digest string, content binary")


def open_seen(spark: SparkSession, state: str, buckets: int) -> VersionedTable:
    """The table of files seen so far, made empty at first."""
    if VersionedTable.exists(spark, state):
        return VersionedTable.open(spark, state)
    return VersionedTable.create(spark, state, spark.createDataFrame([], SEEN), "path", buckets)


def find_changes(spark: SparkSession, root: str, seen: VersionedTable) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed, touched, gone) files against the table `seen`.

    `changed` has path, stamp, digest and content of files that are new or have other bytes;
    `touched` path, stamp, digest and scanned of files with a new stamp and the same bytes;
    `gone` the path of files that are no longer there. Only files whose stamp is new are opened,
    each once; their bytes are written down, so that what is scanned is what was compared.
    """
    listed = settle(list_stamps(spark, root), "listed")
    known = seen.read()
    fresh = listed.join(known.select("path", "stamp"), ["path", "stamp"], "left_anti")
    tasks = max(64, 4 * spark.sparkContext.defaultParallelism)
    read = settle(read_stamped(fresh.repartition(tasks, "path"), root), "changed-files")
    same = known.select("path", "digest", "scanned")
    changed = read.join(same.drop("scanned"), ["path", "digest"], "left_anti")
    touched = read.drop("content").join(same, ["path", "digest"])
    gone = known.select("path").join(listed, "path", "left_anti")
    return changed, touched.select("path", "stamp", "digest", "scanned"), gone
