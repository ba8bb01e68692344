"""Near-duplicate vectors by cross-polytope hashing.

Equal vectors of one label are one class first. A class is rotated by random signs and fast
Hadamard transforms; the largest coordinate and its sign is a hash, `HASHES` of them name a
bucket in each of `TABLES` tables. Besides its home bucket a class visits the `PROBES` buckets it
only just missed. A pair is looked at where one is at home and the other is at home or visits, and
counts in the first such table alone, so that links add up without a list of all pairs. Large
buckets are cut into blocks of rows against rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.operators.skew import salted_join
from riskloom.session import settle

TABLES = 5
HASHES = 2
PROBES = 3
COSINE = 0.98
CHUNK = 1_000
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n = x.shape[1]
    x = x.copy()
    half = 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def bucket_codes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
                 seed: int = SEED) -> np.ndarray:
    """Per row and table the home bucket and the buckets to visit: int64 (rows, tables, 1 + probes)."""
    width = 1 << max(1, int(np.ceil(np.log2(max(2, x.shape[1])))))
    padded = np.zeros((len(x), width))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    padded[:, : x.shape[1]] = x / np.where(norm > 0, norm, 1)
    random = np.random.default_rng([seed, width])
    rows, base = np.arange(len(x)), 2 * width
    near = min(1 + probes, width)
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    for table in range(tables):
        home = np.zeros(len(x), np.int64)
        moves, gaps = [], []
        for h in range(hashes):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * random.choice([-1.0, 1.0], width))
            size = np.abs(turned)
            order = np.argsort(-size, axis=1, kind="stable")[:, :near]
            codes = 2 * order + (np.take_along_axis(turned, order, 1) < 0)
            home += codes[:, 0] * base**h
            best = size[rows, order[:, 0]]
            for k in range(1, near):
                moves.append((codes[:, k] - codes[:, 0]) * base**h)
                gaps.append(best - size[rows, order[:, k]])
        out[:, table, 0] = home
        nearest = np.argsort(np.stack(gaps, 1), axis=1, kind="stable")[:, :probes]
        chosen = np.take_along_axis(np.stack(moves, 1), nearest, 1)
        out[:, table, 1:] = home[:, None]
        out[:, table, 1:1 + chosen.shape[1]] += chosen
    return out


def usable(vector: str, *also: str):
    """The vector has components, all finite, not all zero; other columns are not null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)
    for name in also:
        ok = ok & F.col(name).isNotNull()
    return F.coalesce(ok, F.lit(False))


def _hashed(classes: DataFrame) -> DataFrame:
    """One row per class: its vector as bytes, and the codes of all its buckets."""
    def hash_rows(batches):
        for batch in batches:
            lists = batch.column(3).to_pylist()
            sizes = np.array([len(v) for v in lists])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.array([lists[i] for i in at], np.float64)
                codes = bucket_codes(x)
                single = x.astype(np.float32)
                raw = single if np.array_equal(single, x) else x  # floats stay floats
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(rows) for i in range(3)), pa.array(np.full(len(at), size), pa.int32()),
                     pa.array([v.tobytes() for v in raw], pa.binary()),
                     pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(list(codes.reshape(len(at), -1)), pa.list_(pa.int64()))],
                    names=["cls", "n", "label", "dim", "vector", "codes", "buckets"])

    return classes.select("cls", "n", "label", "vector").mapInArrow(
        hash_rows, "cls bigint, n bigint, label string, dim int, vector binary, codes binary, buckets array<bigint>")


def _entries(hashed: DataFrame) -> DataFrame:
    """One row per class and bucket."""
    place = F.posexplode("buckets").alias("_at", "bucket")
    each = 1 + PROBES
    return (hashed.select("label", "dim", "cls", "n", "vector", "codes", place)
            .withColumn("tab", F.floor(F.col("_at") / each).cast("int"))
            .withColumn("home", F.col("_at") % each == 0).drop("_at"))


class Block:
    """The members of one bucket (or of two of its parts): pairs that count here, and their links."""

    def __init__(self, table: int, bucket: int, left: int, right: int, cosine: float, rows: dict[str, list]):
        self.table, self.bucket, self.split, self.cosine = table, bucket, left != right, cosine
        self.cls, self.n = np.array(rows["cls"], np.int64), np.array(rows["n"], np.int64)
        self.home, self.part = np.array(rows["home"], bool), np.array(rows["part"])
        width = len(rows["vector"][0])
        kind = np.float32 if width == 4 * rows["dim"][0] else np.float64
        self.x = np.array([np.frombuffer(v, kind) for v in rows["vector"]], np.float64)
        self.x /= np.sqrt((self.x * self.x).sum(axis=1, keepdims=True))
        self.codes = np.array([np.frombuffer(c, np.int64) for c in rows["codes"]]).reshape(len(self.cls), TABLES, -1)

    def linked(self) -> np.ndarray:
        """Boolean matrix of links between a row and a later one that count in this bucket."""
        m = len(self.cls)
        out = np.zeros((m, m), bool)
        step = max(1, 2_000_000 // m)
        for at in range(0, m, step):
            rows = slice(at, min(m, at + step))
            near = self.x[rows] @ self.x.T >= self.cosine - 1e-9
            near &= np.arange(m)[None, :] > np.arange(m)[rows, None]
            near &= self.home[rows, None] | self.home[None, :]
            near &= self.cls[rows, None] != self.cls[None, :]
            if self.split:
                near &= self.part[rows, None] != self.part[None, :]
            if not near.any():
                continue
            a, b = np.nonzero(near)
            keep = np.ones(len(a), bool)
            for lo in range(0, len(a), 100_000):  # bounded memory however many pairs are near
                hi = lo + 100_000
                keep[lo:hi] = self._counts_here(a[lo:hi] + at, b[lo:hi])
            out[a[keep] + at, b[keep]] = True
        return out

    def _counts_here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        exact = (self.x[a] * self.x[b]).sum(axis=1) >= self.cosine
        ca, cb = self.codes[a], self.codes[b]
        meet = ((ca[:, :, :1] == cb).any(axis=2) | (cb[:, :, :1] == ca).any(axis=2))
        first = meet[:, : self.table].sum(axis=1) == 0
        # Each may be at home where the other visits: the smaller of the two buckets counts.
        ha, hb = ca[:, self.table, 0], cb[:, self.table, 0]
        other = np.where(ha == self.bucket, hb, ha)
        mutual = (ha != hb) & (ca[:, self.table, 1:] == hb[:, None]).any(axis=1) \
            & (cb[:, self.table, 1:] == ha[:, None]).any(axis=1)
        return exact & first & ~(mutual & (other < self.bucket))

    def result(self) -> list[tuple[int, int | None, int]]:
        """(class, class it hangs on or null, vectors linked) for every class with a link."""
        pairs = self.linked()
        if not pairs.any():
            return []
        both = pairs | pairs.T
        adds = both @ self.n
        root = np.arange(len(self.cls))
        touched = np.flatnonzero(both.any(axis=1))
        seen = np.zeros(len(self.cls), bool)
        for i in touched:
            if seen[i]:
                continue
            front = np.array([i])
            seen[i] = True
            while len(front):
                root[front] = i
                front = np.flatnonzero(both[front].any(axis=0) & ~seen)
                seen[front] = True
        return [(int(self.cls[i]), int(self.cls[root[i]]) if root[i] != i else None, int(adds[i])) for i in touched]


def _links(entries: DataFrame, cosine: float) -> DataFrame:
    """(cls, hangs_on, adds) rows of all blocks."""
    keys = ["label", "dim", "tab", "bucket"]
    large = settle(entries.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > CHUNK)
                   .select(*keys, F.ceil(F.col("_n") / CHUNK).cast("int").alias("_parts")), "large-buckets")
    parts = F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.xxhash64("cls"), parts).cast("int")
    met = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(
        F.least(q, F.col("part")).alias("lo"), F.greatest(q, F.col("part")).alias("hi")))
    dealt = (entries.join(large, keys, "left").withColumn("part", own)
             .select(*keys, "home", "cls", "n", "vector", "codes", "part", F.inline(met)))
    keys += ["lo", "hi"]

    def blocks(batches):
        names, held, key = None, None, None

        def close():
            if held is None or len(held["cls"]) < 2 or not any(held["home"]):
                return []
            return Block(key[2], key[3], key[4], key[5], cosine, held).result()

        for batch in batches:
            names = batch.schema.names
            columns = {name: batch.column(i).to_pylist() for i, name in enumerate(names)}
            at = list(zip(*(columns[k] for k in keys), strict=True))
            out, i = [], 0
            while i < len(at):
                j = i + 1
                while j < len(at) and at[j] == at[i]:
                    j += 1
                rows = {k: v[i:j] for k, v in columns.items()}
                if at[i] == key:
                    for k in held:
                        held[k] += rows[k]
                else:
                    out += close()
                    key, held = at[i], rows
                i = j
            yield pa.RecordBatch.from_pylist([dict(zip(("cls", "hangs_on", "adds"), r, strict=True)) for r in out], schema)
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("cls", "hangs_on", "adds"), r, strict=True)) for r in close()], schema)

    schema = pa.schema([("cls", pa.int64()), ("hangs_on", pa.int64()), ("adds", pa.int64())])
    return (dealt.repartition(*keys).sortWithinPartitions(*keys, "cls")
            .mapInArrow(blocks, "cls bigint, hangs_on bigint, adds bigint"))


def link_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding",
                 label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of `vectors`.

    Rows are compared if their labels are equal and their vectors equally long. Null keys, null labels, and
    vectors that are null, empty, zero or not finite link with nothing: 0 links, their own component.
    A repeated row is one more vector with the same key. Ties do not arise: the smallest key of a
    component is kept. Empty tables give no rows; other columns are not read. Links found are
    exact (cosine in double precision); how many of all links are found is up to the hashing.
    """
    values = F.col(vector)
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("string").alias("label"),
                          values.alias("vector"))
    fit = usable("vector", "key", "label")
    rows = rows.select("key", "vector", F.when(fit, F.col("label")).alias("label"),
                       F.when(fit, F.xxhash64("vector")).alias("h1"),
                       F.when(fit, F.xxhash64(F.reverse("vector"), F.lit(SEED))).alias("h2"))
    same = ["label", "h1", "h2"]  # 128 bits name a class
    classes = settle(rows.where("label is not null").groupBy(*same).agg(
        F.min("key").alias("cls"), F.count("*").alias("n"), F.any_value("vector").alias("vector")), "classes")
    found = settle(_links(_entries(settle(_hashed(classes), "hashed")), cosine), "found")
    adds = found.groupBy("cls").agg(F.sum("adds").alias("adds"))
    tree = components(found.where("hangs_on is not null").select(F.col("cls").alias("a"), F.col("hangs_on").alias("b")))
    info = (classes.select(*same, "cls", "n").join(adds, "cls", "left")
            .join(tree.withColumnRenamed("node", "cls"), "cls", "left")
            .where("n > 1 or adds is not null")
            .select(*same, (F.col("n") - 1 + F.coalesce("adds", F.lit(0))).alias("links"),
                    F.coalesce("component", "cls").alias("component")))
    info = settle(info, "linked-classes")
    joined = salted_join(rows.select("key", *same), info, same, "left", salt_from=("key",))
    component = F.coalesce("component", "key")
    return joined.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
                         component.alias("component_id"),
                         F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
