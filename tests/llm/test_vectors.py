"""Vector operators against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.llm import ann, near_vectors
from riskloom.llm.components import components

BASE = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, score string, component long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def unit(vector):
    return np.asarray(vector, np.float64) / np.linalg.norm(np.asarray(vector, np.float64))


def all_pairs(rows, cosine=0.98):
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1]
            and np.isfinite(r[1]).all() and np.any(r[1])]
    links = {}
    for i, a in enumerate(good):
        for j, b in enumerate(good):
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]) \
                    and unit(np.float32(a[1])) @ unit(np.float32(b[1])) >= cosine:
                links.setdefault(i, set()).add(j)
    component = {}
    for i in sorted(range(len(good)), key=lambda i: good[i][0]):
        front = [i] if i not in component else []
        while front:
            k = front.pop()
            if k not in component:
                component[k] = good[i][0]
                front += links.get(k, ())
    out = {(r[0], i): (0, r[0]) for i, r in enumerate(rows)}
    place = {id(r): i for i, r in enumerate(rows)}
    for i, r in enumerate(good):
        out[r[0], place[id(r)]] = (len(links.get(i, ())), component[i])
    return sorted((k[0] is None, k[0] or 0, *(x if x is not None else -1 for x in v)) for k, v in out.items())


def found(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], -1 if r["component_id"] is None else r["component_id"])
                  for r in df.collect())


@pytest.mark.parametrize("chunk", [4, 1_000])
def test_links_equal_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_vectors, "CHUNK", chunk)
    random = np.random.default_rng(chunk)
    rows = []
    for group in range(6):
        center = random.normal(size=16)
        for _ in range(12):
            rows.append([len(rows) + 10, (center + random.normal(size=16) * 0.07).astype(np.float32).tolist(), group % 2])
    for i in range(5):
        rows.append([len(rows) + 10, list(rows[0][1]), 0])
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [[900 + i, v, 0] for i, v in enumerate(odd)]
    rows += [[950, list(rows[0][1]), None], [None, list(rows[0][1]), 0]]
    df = near_vectors.link_vectors(table(spark, rows))
    assert found(df) == all_pairs(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) if r["vec_id"] is not None else not r["kept"]
               for r in df.collect())


def test_links_of_nothing(spark):
    assert near_vectors.link_vectors(table(spark, [])).count() == 0


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose((near_vectors.hadamard(x) ** 2).sum(1), (x**2).sum(1))
    assert np.allclose(near_vectors.hadamard(near_vectors.hadamard(x)), x)


@pytest.mark.parametrize("hot", [2, 200_000])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr("riskloom.llm.components.HOT_LINKS", hot)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert got == want
    assert components(df.where("a = 999")).count() == 0


def nearest_by_force(queries, rows, most):
    good = [(k, np.float64(np.float32(v))) for k, v, _ in rows
            if k is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for key, v in good:
        if key in queries:
            ranked = sorted((-float((v * w).sum()), k) for k, w in good if k != key)[:most]
            out[key] = [(k, -s) for s, k in ranked]
    return out


def test_search_with_all_lists_is_exact(spark, monkeypatch):
    for name, value in {"LIST": 16, "WIDE": 1e9, "ROWS": 7, "ASKED": 3}.items():
        monkeypatch.setattr(ann, name, value)
    random = np.random.default_rng(5)
    rows = [[i, (random.normal(size=8) * random.uniform(0.5, 2)).astype(np.float32).tolist(), 0] for i in range(150)]
    rows += [[200 + i, list(rows[3][1]), 0] for i in range(60)]
    rows += [[300, None, 0], [301, [0.0] * 8, 0], [302, [float("nan")] * 8, 0], [303, [1.0], 0], [None, [1.0] * 8, 0]]
    df = table(spark, rows)
    got = {}
    for r in ann.search(df.where("vec_id % 7 = 0"), df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = nearest_by_force({r[0] for r in rows if r[0] is not None and r[0] % 7 == 0}, rows, 5)
    assert {k: [x for x, _ in v] for k, v in got.items()} == {k: [x for x, _ in v] for k, v in want.items()}
    assert all(np.allclose([s for _, s in got[k]], [s for _, s in want[k]], rtol=1e-12) for k in want)


def test_search_of_little(spark):
    assert ann.search(table(spark, []), table(spark, [])).count() == 0
    one = table(spark, [[1, [1.0, 2.0], 0]])
    assert ann.search(one, one).count() == 0
    two = table(spark, [[1, [1.0, 2.0], 0], [2, [1.0, 0.0], 0]])
    assert [tuple(r) for r in ann.search(one, two).collect()] == [(1, 1, 2, 1.0)]


def test_graph_search_finds_the_nearest_centroids():
    random = np.random.default_rng(3)
    centroids = random.normal(size=(600, 12))
    index = ann.Index(centroids, ann.neighbour_graph(centroids), 50.0)
    x = random.normal(size=(40, 12))
    order, dist = index.search(x, 64)
    exact = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert np.allclose(dist, np.take_along_axis(exact, order, 1))
    assert np.mean(order[:, 0] == exact.argmin(1)) >= 0.95


@pytest.mark.parametrize("clusters", [0, 150])
def test_search_with_many_lists(spark, monkeypatch, clusters):
    monkeypatch.setattr(ann, "LIST", 8)
    random = np.random.default_rng(11)
    x = random.normal(size=(6_000, 24))
    if clusters:
        x = 0.4 * x + random.normal(size=(clusters, 24))[random.integers(clusters, size=6_000)]
    x = x.astype(np.float32)
    df = table(spark, [[i, v.tolist(), 0] for i, v in enumerate(x)]).repartition(4)
    plain = df.select(F.col("vec_id").cast("long").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))
    index, asked = ann.fit(plain), np.arange(0, 6_000, 60)
    assert len(index.centroids) >= 700 and index.ratio >= ann.WIDE
    # The graph finds nearly all lists within the ratio.
    q = index.asked(x[asked].astype(np.float64))
    near = np.sqrt(((q[:, None] - index.centroids[None]) ** 2).sum(2))
    want = near <= index.ratio * near.min(axis=1, keepdims=True)
    row, _, found = index.within(q)
    assert want[row, found].sum() >= 0.99 * want.sum()
    read = ann._assign(plain.where("key % 60 = 0"), spark.sparkContext.broadcast(index), True)
    assert read.count() == len(row)
    found = {}
    for r in ann.search(df.where("vec_id % 60 = 0"), df).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in asked.tolist():
        scores = x.astype(np.float64) @ x[i]
        scores[i] = -np.inf
        hits += len(found[i] & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(asked), hits / 20 / len(asked)


def test_search_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet(f"{BASE}/embeddings.parquet").collect()]
    keys = np.array([k for k, _, _ in rows])
    x = np.array([v for _, v, _ in rows], np.float64)
    got = {}
    for r in entry.queries()["op6_posting_lists"](spark, BASE).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    asked = np.flatnonzero(keys % 20 == 0)
    assert set(got) == set(keys[asked].tolist())
    for i in asked:
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(got[keys[i]] & set(keys[np.lexsort((keys, -scores))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(asked)


def test_link_query_equals_all_pairs(spark):
    rows = [[r["vec_id"], r["embedding"], r["label"]]
            for r in spark.read.parquet(f"{BASE}/embeddings.parquet").collect()]
    assert found(entry.queries()["op1_cross_polytope"](spark, BASE)) == all_pairs(rows)
