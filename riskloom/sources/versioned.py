"""Keyed tables that are changed in place: buckets, change files and versions.

A table lies in a folder that all executors reach. Rows are in buckets by the hash of their
key; a version says, for each bucket, which written set holds its base and which sets hold
later changes. Writers add files under names of their own and put the version's file in place
last, so readers always see one whole version, and a job that fails leaves the former one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETED, BUCKET, SET = "_deleted", "bucket", "_set"


class VersionConflict(RuntimeError):
    """Another writer has put the same version in place."""


class _Folder:
    """The few calls on a shared folder that versions need, through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.root = root
        path = self.hadoop.Path(root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        where = self.path(name)
        if not self.fs.exists(where):
            return []
        return sorted(status.getPath().getName() for status in self.fs.listStatus(where))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, content: str) -> None:
        """Write aside, then rename: a name that is taken is never replaced."""
        draft, final = self.path(f"drafts/{uuid.uuid4().hex}"), self.path(name)
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(final.getParent())
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            raise VersionConflict(f"{self.root}/{name} is already in place")


class VersionedTable:
    """A table of unique keys in `root`; see `create` and `open`.

    Keys are one column. Rows with a null key may be in the first content and are never
    changed; changes without a key are left out. Where a key is repeated in the first content,
    its rows stay until a change replaces them all. One writer at a time: a second one that
    started from the same version gets `VersionConflict` and changes nothing. (The rename is
    atomic on HDFS and local disks; object stores need a lock of their own.)
    The file of a version has two entries a bucket at most, whatever the rows.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = _Folder(spark, self.root)
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no versioned table in {root}")
        self.version = versions[-1] if version is None else version
        if self.version not in versions:
            raise ValueError(f"no version {version} in {root}")
        state = json.loads(self.folder.read(f"versions/{self.version:012d}.json"))
        self.key, self.buckets = state["key"], state["buckets"]
        self.schema = T.StructType.fromJson(state["schema"])
        self.base: dict[str, str] = state["base"]
        self.changes: dict[str, list[str]] = state["changes"]

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> VersionedTable:
        return cls(spark, root, version)

    @classmethod
    def exists(cls, spark: SparkSession, root: str) -> bool:
        return bool(_Folder(spark, root.rstrip("/")).names("versions"))

    @classmethod
    def create(cls, spark: SparkSession, root: str, df: DataFrame, key: str,
               buckets: int = 1_000) -> VersionedTable:
        """Version 0 of a table. Choose `buckets` for about 256 MB each at full size."""
        reserved = {DELETED, BUCKET, SET} & set(df.columns)
        if reserved:
            raise ValueError(f"reserved column names: {sorted(reserved)}")
        made = cls.__new__(cls)
        made.spark, made.root, made.key, made.buckets = spark, root.rstrip("/"), key, buckets
        made.folder, made.schema, made.version = _Folder(spark, made.root), df.schema, -1
        made.base, made.changes = {}, {}
        name, touched = made._write(df)
        made._commit({b: name for b in touched}, {})
        return cls(spark, root)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("versions") if n.endswith(".json")]

    # Writing ---------------------------------------------------------------------------

    def _bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Write rows as a set of their own; its name and the buckets it has."""
        name = uuid.uuid4().hex
        (rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
         .write.partitionBy(BUCKET).parquet(f"{self.root}/sets/{name}"))
        return name, [n.split("=")[1] for n in self.folder.names(f"sets/{name}") if "=" in n]

    def _commit(self, base: dict[str, str], changes: dict[str, list[str]]) -> None:
        self.folder.put(f"versions/{self.version + 1:012d}.json", json.dumps({
            "key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue(),
            "base": base, "changes": changes}))

    def upsert(self, rows: DataFrame, order: str | None = None) -> VersionedTable:
        """Put whole rows in by key; with a true `_deleted` the key leaves the table.

        Of several rows of one key the last by `order` counts, ties and no order by the largest
        row. Only buckets with changes get files. Nothing to change makes no new version.
        """
        if DELETED not in rows.columns:
            rows = rows.withColumn(DELETED, F.lit(False))
        given = rows.where(F.col(self.key).isNotNull())
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        whole = F.struct(*fields, F.coalesce(DELETED, F.lit(False)).alias(DELETED))
        # Maps cannot be compared: rows are ordered by their text.
        rank = F.struct(F.col(order) if order else F.lit(0), F.to_json(whole))
        last = (given.select(F.col(self.key).alias("_key"), whole.alias("_row"), rank.alias("_rank"))
                .groupBy("_key").agg(F.max_by("_row", "_rank").alias("_row")).select("_row.*"))
        name, touched = self._write(last)
        if not touched:
            return self
        changes = {**self.changes, **{b: [*self.changes.get(b, []), name] for b in touched}}
        self._commit(self.base, changes)
        return VersionedTable(self.spark, self.root)

    def edit(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> VersionedTable:
        """Upsert what `change` makes of the rows whose key is in `keys`."""
        return self.upsert(change(self.rows_of(keys)))

    def compact(self, least: int = 4) -> VersionedTable:
        """Merge the changes of buckets that have `least` sets of them; no other is rewritten."""
        due = [b for b, sets in self.changes.items() if len(sets) >= least]
        if not due:
            return self
        name, kept = self._write(self.read(due))
        base = {b: s for b, s in self.base.items() if b not in due} | {b: name for b in kept}
        self._commit(base, {b: s for b, s in self.changes.items() if b not in due})
        return VersionedTable(self.spark, self.root)

    # Reading ---------------------------------------------------------------------------

    def _files(self, paths: Sequence[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, buckets: Iterable[str] | None = None) -> DataFrame:
        """The rows of this version, all or those of some buckets.

        Buckets without changes are a plain scan. Elsewhere the latest change of each key takes
        the place of its base row; base rows only move if the changes are too large to broadcast.
        """
        wanted = set(map(str, buckets if buckets is not None else {*self.base, *self.changes}))
        clean = [f"{self.root}/sets/{s}/{BUCKET}={b}" for b, s in self.base.items()
                 if b in wanted and not self.changes.get(b)]
        mixed = [f"{self.root}/sets/{s}/{BUCKET}={b}" for b, s in self.base.items()
                 if b in wanted and self.changes.get(b)]
        out = self._files(clean, self.schema)
        sets = {(n, s): [f"{self.root}/sets/{s}/{BUCKET}={b}" for b, of in self.changes.items()
                         if b in wanted and s in of]
                for n, s in enumerate(dict.fromkeys(s for of in self.changes.values() for s in of))}
        if not any(sets.values()):
            return out
        # Sets are numbered by the file's folder, in the order in which they were committed.
        changed = T.StructType([*self.schema.fields, T.StructField(DELETED, T.BooleanType())])
        place = F.create_map(*[F.lit(v) for (n, s) in sets for v in (s, n)])
        source = F.regexp_extract(F.col("_metadata.file_path"), f"/sets/([0-9a-f]+)/{BUCKET}=", 1)
        rows = self._files([p for paths in sets.values() for p in paths], changed)
        names = [*self.schema.names, DELETED]
        latest = (rows.select(F.struct(*names).alias("_row"), place[source].alias(SET))
                  .groupBy(F.col("_row")[self.key].alias("_key"))
                  .agg(F.max_by("_row", SET).alias("_row")))
        kept = self._files(mixed, self.schema).join(
            latest.select(F.col("_key").alias(self.key)), self.key, "left_anti")
        return out.unionByName(kept.select(*self.schema.names)).unionByName(
            latest.select("_row.*").where(~F.col(DELETED)).drop(DELETED))

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in column `key` of `keys`; other buckets are not opened."""
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        hit = [str(r[0]) for r in asked.select(self._bucket().alias("b")).distinct().collect()]
        return self.read(hit).join(asked, self.key, "left_semi").select(*self.schema.names)
