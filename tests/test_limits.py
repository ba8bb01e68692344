"""Time-sliced windows, sessions and the limiter against plain loops; stream = batch."""

import datetime
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import limits
from riskloom.streaming import jobs, limiter

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, ip string, ts timestamp, failed boolean"


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, ip, START + datetime.timedelta(seconds=s), f) for i, (ip, s, f) in enumerate(rows)],
        SCHEMA)


def replay(rows, seconds=900, limit=5):
    """The limiter as a loop over the attempts of each key."""
    recent, out = {}, {}
    for i, (ip, s, failed) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        live = [t for t in recent.get(ip, []) if s - t < seconds]
        out[i] = len(live) >= limit
        recent[ip] = live + [s] if failed and not out[i] else live
    return out


def limited(df, **options):
    rows = limits.rate_limit(df, "ip", "ts", "failed", "id", **options).collect()
    out = {r["id"]: r["blocked"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_limiter_case(spark):
    rows = [("a", s, True) for s in (0, 10, 20, 30, 40, 50, 60, 910, 920, 2000)]
    got = limited(frame(spark, rows))
    assert [i for i, b in got.items() if b] and {i for i, b in got.items() if b} == {5, 6}


@pytest.mark.parametrize("seed,gap,ties", [(1, 60, 1), (2, 250, 1), (3, 20, 30), (4, 2000, 1)])
def test_limiter_matches_loop(spark, seed, gap, ties):
    rng = random.Random(seed)
    rows, now = [], 0.0
    for _ in range(600):
        now += rng.expovariate(1 / gap)
        if rng.random() < 0.05:
            now += 1800
        at = int(now / ties) * ties if ties > 1 else round(now, 3)
        rows.append((rng.choice("aaab"), at, rng.random() < 0.8))
    want = replay(rows)
    assert any(want.values()) or gap == 2000
    df = frame(spark, rows).repartition(5)
    assert limited(df) == want
    # Long stretches in several rounds: chunks of one, two or five windows.
    if gap < 100:
        for chunk in (1, 2, 5):
            assert limited(df, chunk_windows=chunk) == want


def test_limiter_other_settings(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randint(0, 5000), True) for _ in range(300)]
    assert limited(frame(spark, rows), seconds=100, limit=2) == replay(rows, 100, 2)


def test_trailing_count_is_strict(spark):
    rows = [("a", s, True) for s in (0, 1, 899, 900, 901, 1800)]
    got = limits.trailing_count(frame(spark, rows), "ip", "ts", 900).orderBy("id")
    assert [r["n_recent"] for r in got.collect()] == [1, 2, 3, 3, 3, 2]


def test_idle_sessions_match_loop(spark):
    rng = random.Random(6)
    rows, now = [], 0
    for _ in range(300):
        now += rng.choice([10, 100, 5399, 5400, 7199, 7200, 20000])
        rows.append((rng.choice("ab"), now, False))
    want = []
    for key in "ab":
        times = [s for ip, s, _ in rows if ip == key]
        groups = [[times[0]]]
        for a, b in zip(times, times[1:]):
            groups[-1].append(b) if b - a < 7200 else groups.append([b])
        want += [(key, n + 1, len(g), any(b - a >= 5400 for a, b in zip(g, g[1:])),
                  START + datetime.timedelta(seconds=g[0])) for n, g in enumerate(groups)]
    got = limits.idle_sessions(frame(spark, rows), "ip", "ts").collect()
    assert sorted((r["ip"], r["session"], r["n_events"], r["warned"], r["session_start"])
                  for r in got) == sorted(want)


def test_token_expiry(spark):
    asked = frame(spark, [("a", 0, False), ("a", 5000, False), ("b", 100, False)])
    used = frame(spark, [("a", 0, True), ("a", 899, True), ("a", 900, True), ("a", 5001, True),
                         ("b", 99, True), ("c", 1, True)])
    got = limits.token_expiry(asked, used, "ip", "ts", "id").orderBy("id").collect()
    assert [(r["is_valid"], r["age_seconds"]) for r in got] == [
        (True, 0), (True, 899), (False, None), (True, 1), (False, None), (False, None)]


# Streams -----------------------------------------------------------------------------

def write_batches(spark, df, folder, n):
    """Rows in time order as `n` files, which a stream reads one by one."""
    rows = [tuple(r) for r in df.orderBy("ts", "id").collect()]
    step = -(-len(rows) // n)
    for i in range(n):
        part = spark.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/in")


def read_stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.mark.parametrize("late,slot", [(0, 60), (700, 60), (700, 5000)])
def test_stream_limiter_equals_batch(spark, tmp_path, late, slot):
    jobs.use_rocksdb(spark)
    rng = random.Random(11 + late)
    rows, now = [], 0
    for _ in range(200):
        now += rng.choice([0, 20, 40, 60, 300, 1000] if late else [20, 40, 60, 300, 1000])
        rows.append((rng.choice("ab"), now, rng.random() < 0.9))
    want = limited(frame(spark, rows))
    assert want == replay(rows) and any(want.values())
    # Later rows move the watermark past all slots, so that every attempt is answered.
    df = frame(spark, [*rows, ("end", now + 9_000, False), ("end", now + 19_000, False)])
    made = [tuple(r) for r in df.orderBy("id").collect()]
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + rng.random() * late)
    for part in (order[:70], order[70:140], order[140:], [len(rows)], [len(rows) + 1]):
        spark.createDataFrame([made[i] for i in part], df.schema).coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/in")
    stream = limiter.rate_limit_stream(read_stream(spark, df.schema, tmp_path), "ip", "ts",
                                       "failed", "id", delay=f"{late} seconds", slot_seconds=slot)
    name = f"limited_{late}_{slot}"
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).start())
    query.processAllAvailable()
    query.stop()
    got = spark.table(name).where("ip <> 'end'").collect()
    assert len(got) == len(rows) and {r["id"]: r["blocked"] for r in got} == want
    left = limits.rate_limit(frame(spark, rows), "ip", "ts", "failed", "id").collect()
    assert {r["id"]: r["remaining"] for r in got} == {r["id"]: r["remaining"] for r in left}
    assert all(r["blocked"] == (r["remaining"] == 0) for r in got)


def test_decide_equals_loop_whatever_the_cut():
    rng = random.Random(5)
    for trial in range(60):
        n, cut = 80, rng.randrange(80)
        times = sorted(rng.randrange(0, 400) for _ in range(n))
        failed = [rng.random() < 0.8 for _ in range(n)]
        want, live = [], []
        for now, bad in zip(times, failed):
            live = [t for t in live if now - t < 90]
            want.append(len(live))
            live += [now] if bad and len(live) < 3 else []
        times, failed = np.array(times), np.array(failed)
        first, kept = limiter.decide(times[:cut], failed[:cut], [], 90, 3)
        second, kept = limiter.decide(times[cut:], failed[cut:], kept, 90, 3)
        assert [*first, *second] == want and len(kept) <= 3


def test_stream_audit_windows(spark, tmp_path):
    rows = [("a", s, s % 2 == 0) for s in range(0, 7200, 60)]
    df = frame(spark, rows).withColumnRenamed("ts", "timestamp").withColumn(
        "action", F.when(F.col("failed"), "X").otherwise("Y")).withColumnRenamed(
        "timestamp", "ts")
    write_batches(spark, df, tmp_path, 2)
    source = read_stream(spark, df.schema, tmp_path).withColumnRenamed("ts", "timestamp")
    query = (jobs.audit_stream(source).writeStream.format("memory").queryName("windows")
             .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start())
    query.processAllAvailable()
    query.stop()
    batch = limits.action_windows(df.withColumnRenamed("ts", "timestamp"), "timestamp", "action")
    want = {(r["window_start"], r["action"]): r["n"] for r in batch.collect()}
    got = {(r["window_start"], r["action"]): r["n"] for r in spark.table("windows").collect()}
    assert got and all(want[k] == n for k, n in got.items())
    # Only windows the watermark has not passed are still open.
    assert {k[0] for k in want} - {k[0] for k in got} <= {
        START + datetime.timedelta(seconds=s) for s in (5400, 6300)}


def test_stream_sessions(spark, tmp_path):
    rows = [("a", s, False) for s in (0, 100, 7100, 20000, 20010, 90000)]
    df = frame(spark, rows)
    write_batches(spark, df, tmp_path, 2)
    stream = jobs.session_stream(read_stream(spark, df.schema, tmp_path), "ip", "ts")
    query = (stream.writeStream.format("memory").queryName("sessions").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).start())
    query.processAllAvailable()
    query.stop()
    got = sorted((r["session_start"], r["n_events"]) for r in spark.table("sessions").collect())
    batch = limits.idle_sessions(df, "ip", "ts").orderBy("session").collect()
    assert got == [(r["session_start"], r["n_events"]) for r in batch][:2]


def test_stream_scan(spark, tmp_path):
    code = spark.createDataFrame([(1, "os.system(x)"), (2, "pass")], "id long, code string")
    code.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(code.schema).parquet(f"{tmp_path}/in")
    writer = jobs.append_batches(jobs.scan_stream(source), str(tmp_path / "out"),
                                 f"scan-{uuid.uuid4().hex}")
    for _ in range(2):
        query = writer.trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["id"], r["is_vulnerable"]) for r in got) == [(1, True), (2, False)]
