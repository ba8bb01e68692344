"""Streams against their batch forms, on rows that arrive out of order within the watermark."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import limits
from riskloom.streaming import jobs, sessions

START = datetime.datetime(2024, 1, 1)
COLUMNS = "ip string, ts timestamp, id long"


def batches_of(spark, rows, folder, parts):
    """Write rows (ip, second, id) as one file per micro-batch; `parts` lists the rows of each."""
    for i, part in enumerate(parts):
        made = [(rows[j][0], START + datetime.timedelta(seconds=rows[j][1]), rows[j][2]) for j in part]
        spark.createDataFrame(made, COLUMNS).coalesce(1).write.parquet(f"{folder}/tmp-{i}")
        (folder / "in").mkdir(exist_ok=True)
        for file in (folder / f"tmp-{i}").glob("*.parquet"):
            file.rename(folder / "in" / f"{i:04d}.parquet")


def stream_of(spark, folder):
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(stream, name, folder):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(folder / "cp")).start())
    query.processAllAvailable()
    query.stop()
    return query


def late_batches(rng, rows, n, most):
    """Rows in order of time, each moved back by up to `most` seconds of others, cut into `n` micro-batches."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + rng.random() * most)
    step = -(-len(order) // n)
    return [order[i:i + step] for i in range(0, len(order), step)]


@pytest.mark.parametrize("late", [0, 3_000])
def test_idle_sessions_of_a_stream_equal_the_batch(spark, tmp_path, late):
    jobs.use_rocksdb(spark)
    rng, rows, now = random.Random(late), [], 0
    for i in range(150):
        now += rng.choice([0, 30, 900, 5_000, 5_500, 7_199, 7_200, 9_000])
        rows.append((rng.choice(["a", "b", "b", "c"]), now, i))
    parts = late_batches(rng, rows, 4, late)
    rows += [("end", now + 50_000, 1000), ("end", now + 90_000, 1001)]
    batches_of(spark, rows, tmp_path, [*parts, [150], [151]])
    stream = sessions.idle_sessions_stream(stream_of(spark, tmp_path), "ip", "ts", delay=f"{late + 1} seconds")
    run(stream, f"idle_{late}", tmp_path)
    made = [(k, START + datetime.timedelta(seconds=s), i) for k, s, i in rows]
    want = limits.idle_sessions(spark.createDataFrame(made, COLUMNS), "ip", "ts").where("ip <> 'end'").collect()
    got = spark.table(f"idle_{late}").where("ip <> 'end'").select(
        "ip", "session", "session_start", "session_end", "n_events", "warned").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r["warned"] for r in got}) == 2


def test_token_expiry_of_streams_equals_the_batch(spark, tmp_path):
    jobs.use_rocksdb(spark)
    rng, sides = random.Random(2), []
    for n in (40, 120):
        rows = [(rng.choice("abc"), rng.randrange(0, 20_000, 50), i) for i in range(n)]
        sides.append(rows)
    sides[0] += [("a", 100, 90), ("b", 1_000, 91)]
    sides[1] += [("a", 100, 190), ("a", 100 + 899, 191), ("b", 1_000 + 900, 192), ("b", 999, 193)]
    frames = []
    for i, rows in enumerate(sides):
        folder = tmp_path / f"side{i}"
        folder.mkdir()
        rows.sort(key=lambda r: r[1])
        parts = late_batches(rng, rows, 4, 300)
        rows += [("end", 60_000 + k * 10_000, 1000 + k) for k in range(2)]
        batches_of(spark, rows, folder, [*parts, [len(rows) - 2], [len(rows) - 1]])
        frames.append(spark.createDataFrame(
            [(k, START + datetime.timedelta(seconds=s), j) for k, s, j in rows], COLUMNS))
    # Both sides go on at the same pace only roughly: the delay covers a batch's span.
    stream = sessions.token_expiry_stream(*(stream_of(spark, tmp_path / f"side{i}") for i in (0, 1)), "ip", "ts", "id",
                                          delay="3 hours")
    query = run(stream, "expiry", tmp_path)
    want = limits.token_expiry(*frames, "ip", "ts", "id").where("id < 1000").collect()
    got = spark.table("expiry").where("id < 1000").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert 0 < sum(r["is_valid"] for r in got) < len(got)
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] < max(held)  # old requests and answered uses have left
