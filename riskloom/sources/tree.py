"""Source trees, archives and text decoding.

Spark's file sources leave out names that start with `_` or `.` (so `__init__.py`) and
empty files, hence a reader of its own for trees. It needs a folder every executor can
open. Files on object stores that follow Spark's naming can use `binaryFile` instead.
"""

from __future__ import annotations

import itertools
import os
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import fixed
from ..functions import text

BATCH_BYTES = 8 << 20
FILE_SCHEMA = "path string, content binary"
_ARROW_FILES = pa.schema([("path", pa.string()), ("content", pa.binary())])


def keep_dir(name: str) -> bool:
    return name.lower() not in fixed.IGNORED_DIRS and not name.startswith(".")


class Subtrees(InputPartition):
    """Folders to read: each with everything below it, or only its own files."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(folders[0][0])
        self.folders = folders


def plan_subtrees(root: str, wanted: int) -> list[Subtrees]:
    """Open folders level by level until there are `wanted` of them; deal them to `wanted` tasks.

    The driver only handles folder names of the upper levels; files are listed by the tasks.
    Links to folders are not followed, here as little as below.
    """
    level: list[str] = [root]
    plan: list[tuple[str, bool]] = []
    while level and len(level) < wanted:
        below: list[str] = []
        for folder in level:
            plan.append((folder, False))
            try:
                with os.scandir(folder) as entries:
                    below += sorted(e.path for e in entries
                                    if e.is_dir(follow_symlinks=False) and keep_dir(e.name))
            except OSError:
                continue
        level = below
    plan += [(folder, True) for folder in level]
    return [Subtrees(plan[i::wanted]) for i in range(min(wanted, len(plan)))]


def _walk(part: Subtrees, suffix: str) -> Iterator[str]:
    for top, deep in part.folders:
        for folder, dirs, names in os.walk(top):
            dirs[:] = sorted(d for d in dirs if keep_dir(d)) if deep else []
            yield from (os.path.join(folder, n) for n in sorted(names)
                        if n.lower().endswith(suffix))


def _batches(files: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    names, blobs, size = [], [], 0
    for name, blob in files:
        names.append(name)
        blobs.append(blob)
        size += len(blob or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(blobs, pa.binary())],
                schema=_ARROW_FILES)
            names, blobs, size = [], [], 0
    if names:
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(blobs, pa.binary())], schema=_ARROW_FILES)


class SourceTreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.suffix = options.get("suffix", ".py").lower()
        self.wanted = int(options.get("partitions", "64"))

    def partitions(self):
        return plan_subtrees(self.root, self.wanted)

    def read(self, partition):
        found = _walk(partition, self.suffix)
        while part := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_pydict(
                {"path": [os.path.relpath(full, self.root) for full in part]})


class SourceTree(DataSource):
    """`spark.read.format("source_tree").load(root)`: the paths of a tree."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string"

    def reader(self, schema):
        return SourceTreeReader(self.options)


def read_source_tree(spark: SparkSession, root: str, partitions: int | None = None
                     ) -> DataFrame:
    """(path, content) of every `.py` file below `root`, ignored folders left out.

    A `root` that is a file is read itself, whatever its name; its path is its base name.
    A missing `root` is an error.

    Paths are listed by the tasks and then spread evenly before any file is opened, so one
    huge folder is not one task's work. Files that cannot be read are skipped.
    """
    base = os.path.abspath(root)
    if not os.path.exists(base):
        raise FileNotFoundError(f"no such file or folder: {root}")
    if os.path.isfile(base):
        base, name = os.path.split(base)
        paths = spark.createDataFrame([(name,)], "path string")
        return paths.mapInArrow(_contents(base), FILE_SCHEMA)
    spark.dataSource.register(SourceTree)
    wanted = partitions or _tasks(spark)
    paths = spark.read.format("source_tree").option("partitions", wanted).load(base)
    return paths.repartition(wanted, "path").mapInArrow(_contents(base), FILE_SCHEMA)


def _contents(base: str):
    def contents(batches):
        def files():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    try:
                        with open(os.path.join(base, path), "rb") as f:
                            yield path, f.read()
                    except OSError:
                        continue
        return _batches(files())

    return contents


def _tasks(spark: SparkSession) -> int:
    """A fixed number of tasks: the paths are too small for their bytes to tell the work."""
    return max(64, 4 * spark.sparkContext.defaultParallelism)


def _member(archive: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        return archive.read(name)
    except (OSError, RuntimeError, NotImplementedError, EOFError, zipfile.BadZipFile, zlib.error):
        return None


def read_source_archives(spark: SparkSession, archives: DataFrame, path: str = "path",
                         partitions: int | None = None) -> DataFrame:
    """(archive, path, content) of the `.py` members of zip files named in `archives`.

    Members are listed first (only the directory of a zip is read) and then spread over the
    tasks by name, so one huge archive is not one task's work. Archives that cannot be opened are left out;
    a member that is encrypted, damaged or packed in an unknown way has null content.
    """
    def members(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                try:
                    with zipfile.ZipFile(archive) as z:
                        names = [n for n in z.namelist() if n.lower().endswith(".py")
                                 and all(keep_dir(d) for d in n.split("/")[:-1])]
                except (OSError, zipfile.BadZipFile):
                    continue
                for at in range(0, len(names), 10_000):
                    part = names[at:at + 10_000]
                    yield pa.RecordBatch.from_pydict(
                        {"archive": [archive] * len(part), "path": part})

    def contents(batches):
        for batch in batches:
            by_archive: dict[str, list[str]] = {}
            for archive, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_archive.setdefault(archive, []).append(name)
            for archive, names in by_archive.items():
                with zipfile.ZipFile(archive) as z:
                    for read in _batches((n, _member(z, n)) for n in names):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([archive] * read.num_rows, pa.string()),
                             *read.columns], names=["archive", "path", "content"])

    listed = archives.select(path).mapInArrow(members, "archive string, path string")
    spread = listed.repartition(partitions or _tasks(spark), "archive", "path")
    return spread.mapInArrow(contents, "archive string, path string, content binary")


def decode_source(content: Column) -> Column:
    """UTF-8 when the bytes are valid UTF-8, else Latin-1; line ends become newlines."""
    as_text = content.cast("string")
    decoded = F.when(F.is_valid_utf8(as_text), as_text).otherwise(
        F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(decoded, r"\r\n?", "\n")


def with_code(files: DataFrame) -> DataFrame:
    """Decoded and cleaned code next to the path."""
    return files.withColumn("source", decode_source(F.col("content"))).drop(
        "content").withColumn("code", text.clean_code(F.col("source")))
