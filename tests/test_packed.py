"""Rows sent in packed blocks, and stored scans put together from them."""

import datetime
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

import __spark_entry__ as entry
from riskloom import fixed
from riskloom.operators import detect, packed, skew
from riskloom.plans import tables
from riskloom.sources import history

ODD = ("k string, n int, d double, t timestamp, b binary, l array<string>, m map<string,int>, "
       "s struct<x: string, y: array<struct<z: long>>>, w date, e decimal(20,3)")


def odd_rows():
    rng = random.Random(3)
    day = datetime.date(1969, 12, 31)
    return [(rng.choice([None, "", "a", "b'\n", "\u0000é"]), rng.choice([None, -1, 2**31 - 1]),
             rng.choice([None, -0.0, float("inf"), 1e-300]), rng.choice([None, datetime.datetime(1901, 1, 2, 3, 4, 5, 6)]),
             rng.choice([None, bytearray(b""), bytearray(b"\xff")]), rng.choice([None, [], [None, "x"], ["x" * 300]]),
             rng.choice([None, {}, {"a": None, "b": 2}]), rng.choice([None, (None, None), ("x", []), ("", [None, (7,)])]),
             rng.choice([None, day]), None) for _ in range(500)]


def test_blocks_give_back_every_row(spark):
    df = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    blocks = packed.pack(df, F.pmod(F.xxhash64("k"), F.lit(4)), "k").toArrow()
    assert blocks.num_rows <= 12
    rows = packed.unpack(blocks["block"], to_arrow_schema(df.schema))
    back = spark.createDataFrame(rows, df.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert packed.unpack(blocks["block"].slice(0, 0), rows.schema).schema == rows.schema


def test_few_rows_held_make_more_blocks_of_the_same_rows():
    batch = pa.RecordBatch.from_pydict({"_bucket": pa.array([2, 0, 2, 1], pa.int32()), "k": [9, 8, 7, None]})
    given = [b for _ in range(3) for b in packed._blocks([batch], "k")]
    assert [b["_bucket"].to_pylist() for b in given] == [[0, 1, 2]] * 3
    rows = packed.unpack(pa.chunked_array([b["block"] for b in given]), pa.schema([("k", pa.int64())]))
    assert rows["k"].to_pylist() == [8, None, 7, 9] * 3


def scans_with_odd_keys(spark):
    scans = spark.createDataFrame(
        [(s, 1, f"t{i}", "2024-01-01 00:00:00", 1, 1, 0, 1, 1) for i, s in enumerate([1, 2, 2, None, None, 3, 9])],
        "scan_id int, user_id long, filename string, scan_time string, total_functions int, "
        "vulnerable_count int, safe_count int, high_risk_count int, files_scanned int")
    rng = random.Random(5)
    rows = [(s, 10 ** 18 * (i % 3) - i if i else None, f"f{i}", rng.choice(["CWE-78: OS Command Injection", "CWE-89: é", "N/A", None]),
             rng.choice([True, False, None]), [f"t{i}", None])
            for s, n in {1: 1, 2: 7, 3: 23, 4: 5, None: 6}.items() for i in range(n)]
    rng.shuffle(rows)
    findings = spark.createDataFrame(rows, "scan_id long, ord long, function_name string, cwe_category string, "
                                           "is_vulnerable boolean, suspicious_tokens array<string>")
    return scans, findings, rows


def wanted(scans, rows, part):
    advice = {k: list(v) for k, v in fixed.REMEDIATION.items()}
    out = []
    for scan in scans.collect():
        mine = sorted((r for r in rows if r[0] is not None and r[0] == scan["scan_id"]),
                      key=lambda r: (r[1] is not None, r[1] or 0))
        shares = {}
        for r in mine:
            if r[4] and r[3] not in (None, "N/A"):
                shares[r[3]] = shares.get(r[3], 0) + 1
        for p in range(max(1, -(-len(mine) // part))):
            out.append((scan["scan_id"], scan["filename"], p, p * part or None, dict(sorted(shares.items())), [
                (r[2], r[3], r[4], r[5], advice.get((r[3] or "").split(":")[0], list(fixed.DEFAULT_REMEDIATION)))
                for r in mine[p * part:(p + 1) * part]]))
    return out


@pytest.mark.parametrize(("hot_rows", "most"), [(1, 99), (6, 99), (10 ** 6, 99), (10 ** 6, 0)])
@pytest.mark.parametrize("part", [4, 10_000])
def test_stored_scans_with_repeated_and_missing_keys(spark, monkeypatch, part, hot_rows, most):
    monkeypatch.setattr(history, "MOST_BUCKETS", most)
    scans, findings, rows = scans_with_odd_keys(spark)
    stored = history.stored_scans(scans, findings, chunk=10 ** 18, part=part, complete=detect.attach_remediation,
                                  hot_rows=hot_rows)
    assert stored.columns == [*scans.columns, "part_no", "scan_result_json"]
    assert stored.schema["scan_id"].dataType == scans.schema["scan_id"].dataType
    got = []
    for r in stored.collect():
        doc = json.loads(r["scan_result_json"])
        assert list(doc["cwe_summary"]) == sorted(doc["cwe_summary"])
        got.append((r["scan_id"], r["filename"], r["part_no"], doc.get("first_position"), doc["cwe_summary"], [
            (f.get("function_name"), f.get("cwe_category"), f.get("is_vulnerable"), f["suspicious_tokens"],
             list(f["remediation"].values())) for f in doc["functions"]]))
    assert sorted(got, key=repr) == sorted(wanted(scans, rows, part), key=repr)


def test_scan_of_long_texts_is_not_left_to_one_task(spark, monkeypatch):
    scans, findings, _ = scans_with_odd_keys(spark)
    assert history._measured(findings, 10 ** 6)[1] == []
    monkeypatch.setattr(history, "BUCKET_BYTES", 500)
    long = findings.withColumn("function_name", F.when(F.col("scan_id") == 3, F.repeat("function_name", F.lit(500)))
                               .otherwise(F.col("function_name")))
    size, heavy = history._measured(long, 10 ** 6)
    assert size > 5_000 and long.where(skew.key_slot(["scan_id"]).isin(heavy)).where("scan_id = 3").count() == 23
    docs = history.stored_scans(scans, long).select("scan_id", "scan_result_json").collect()
    assert sorted(len(json.loads(r[1])["functions"]) for r in docs) == [0, 0, 0, 1, 7, 7, 23]


def test_advice_inside_a_list_is_that_of_rows(spark):
    names = [*fixed.REMEDIATION, "CWE-0: none", "", "N/A", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, cwe_category string")
    listed = rows.groupBy().agg(F.collect_list(F.struct("i", "cwe_category")).alias("l"))
    got = detect.attach_remediation(listed, inside="l").select(F.inline("l")).collect()
    assert sorted(got) == sorted(detect.attach_remediation(rows).collect())


def test_no_scans_and_no_findings(spark):
    scans, findings, _ = scans_with_odd_keys(spark)
    none = history.stored_scans(scans, findings.limit(0)).collect()
    assert len(none) == 7 and all(json.loads(r["scan_result_json"])["functions"] == [] for r in none)
    assert history.stored_scans(scans.limit(0), findings).count() == 0


@pytest.mark.parametrize("hot_rows", [1, 50, 10 ** 6])
def test_shared_out_groups_count_the_same(spark, hot_rows):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(20)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k long, v long")
    shares = skew.share_out(df, ["k"], ["v"], hot_rows=hot_rows).groupBy("k", "_salt").agg(
        F.count("*").alias("n"), F.count_distinct("v").alias("d"))
    got = shares.groupBy("k").agg(F.sum("n"), F.sum("d")).collect()
    want = df.groupBy("k").agg(F.count("*"), F.count_distinct("v")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert (shares.where("_salt > 0").count() > 0) == (hot_rows < 400)


def test_stored_scans_need_little_disk(spark, tmp_path):
    """Shuffle files of the round trip: under 100 bytes a finding (over 400 when rows moved with their advice)."""
    n = 60_000
    at = spark.range(n, numPartitions=2).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(2 ** 40)))
    at.select(F.pmod("h", F.lit(n // 4)).alias("l_orderkey"), F.pmod(F.shiftright("h", 5), F.lit(20_000)).alias("l_partkey"),
              F.pmod(F.shiftright("h", 9), F.lit(1_000)).alias("l_suppkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"),
              (F.pmod("h", F.lit(50)) + 1).cast("double").alias("l_quantity"), (F.pmod("h", F.lit(11)) / 100).alias("l_discount"),
              F.element_at(F.array(F.lit("R"), F.lit("A"), F.lit("N")), (F.pmod("h", F.lit(3)) + 1).cast("int")).alias("l_returnflag"),
              F.lit("O").alias("l_linestatus")).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(n // 4).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 999).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        F.timestamp_seconds("id").alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority")
    ).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files():
        return {os.path.join(d, f) for top in folders for d, _, names in os.walk(top.getPath()) for f in names
                if f.startswith("shuffle_") and f.endswith(".data")}

    before = files()
    back = entry.queries()["json_roundtrip"](spark, str(tmp_path)).toArrow()
    size = sum(os.path.getsize(f) for f in files() - before)
    assert back.num_rows == n
    assert 0 < size < 100 * n
    found = tables.findings(spark, str(tmp_path)).select("scan_id", "function_name").toArrow()
    pairs = lambda t: sorted(zip(t["scan_id"].to_pylist(), t["function_name"].to_pylist(), strict=True))
    assert pairs(back) == pairs(found)
