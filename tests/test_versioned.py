"""Versioned tables against a plain dictionary; failures, conflicts and untouched buckets."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import maintain
from riskloom.sources.versioned import VersionConflict, VersionedTable

SCHEMA = "id long, name string, is_active int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path / "t")
    want = {i: (i, f"n{i}", 1) for i in range(60)}
    table = VersionedTable.create(spark, root, spark.createDataFrame(list(want.values()), SCHEMA), "id", 8)
    seen = [rows_of(table.read())]
    for step in range(4):
        made = []
        for at in range(15):
            key, gone = rng.randrange(75), rng.random() < 0.3
            made.append((key, f"s{step}-{at}", at % 2, at, gone))
            want[key] = None if gone else made[-1][:3]
        made.append((None, "no key", 0, 99, False))
        table = table.upsert(spark.createDataFrame(made, SCHEMA + ", at int, _deleted boolean"), "at")
        if step == 2:
            before = dict(table.changes)
            table = table.compact(3)
            assert any(len(s) >= 3 for s in before.values())
            assert all(len(s) < 3 for s in table.changes.values())
        seen.append(sorted((r for r in want.values() if r), key=repr))
        assert rows_of(table.read()) == seen[-1]
    # Old versions stay readable, 0 and 1 before any compaction.
    assert [rows_of(VersionedTable.open(spark, root, v).read()) for v in (0, 1)] == seen[:2]


def test_one_row_touches_one_bucket_of_a_thousand(spark, tmp_path):
    root = str(tmp_path / "t")
    first = spark.range(5_000).select("id", F.lit("a").alias("name"), F.lit(1).alias("is_active"))
    table = VersionedTable.create(spark, root, first, "id", 1_000)
    after = table.upsert(spark.createDataFrame([(77, "b", 0)], SCHEMA))
    assert len(after.changes) == 1 and after.base == table.base
    done = after.compact(1)
    moved = [b for b in done.base if done.base[b] != table.base[b]]
    assert moved == list(after.changes) and not done.changes
    assert rows_of(done.rows_of(spark.createDataFrame([(77,), (78,), (9_999,)], "id long"))) == [
        (77, "b", 0), (78, "a", 1)]
    assert done.read().count() == 5_000
    assert done.upsert(spark.createDataFrame([], SCHEMA)).version == done.version


def test_failed_and_late_writers_change_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    table = VersionedTable.create(spark, root, spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), "id", 4)
    broken = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], SCHEMA).withColumn(
        "name", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception):
        table.upsert(broken)
    now = VersionedTable.open(spark, root)
    assert now.version == 0 and rows_of(now.read()) == [(1, "a", 1), (2, "b", 1)]
    now.upsert(spark.createDataFrame([(1, "c", 1)], SCHEMA))
    with pytest.raises(VersionConflict):
        table.upsert(spark.createDataFrame([(2, "late", 1)], SCHEMA))
    assert rows_of(VersionedTable.open(spark, root).read()) == [(1, "c", 1), (2, "b", 1)]


def test_updates_flags_and_soft_deletes_equal_the_rewrites(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    users = spark.createDataFrame([(i, f"n{i}", i % 2) for i in range(30)], SCHEMA)
    table = VersionedTable.create(spark, str(tmp_path / "users"), users, "id", 8)
    changes = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (5, 1, None), (90, 1, "z")],
                                    "id long, seq int, name string")
    after = table.edit(changes, lambda rows: maintain.apply_updates(rows, changes, ["name"]))
    assert rows_of(after.read()) == rows_of(maintain.apply_updates(users, changes, ["name"]))
    asked = spark.createDataFrame([(1, 7), (7, 7), (2, 7), (2, 7), (400, 7)], "id long, admin_id long")
    want = rows_of(maintain.toggle_flag(after.read(), asked))
    assert rows_of(after.edit(asked, lambda rows: maintain.toggle_flag(rows, asked)).read()) == want
    scans = spark.createDataFrame([(i, i % 3, day, 0) for i in range(20)],
                                  "id long, user_id long, scan_time timestamp, is_deleted int")
    kept = VersionedTable.create(spark, str(tmp_path / "scans"), scans, "id", 8)
    gone = spark.createDataFrame([(3, 0), (4, 0), (99, 0)], "id long, user_id long")
    got = kept.edit(gone, lambda rows: maintain.soft_delete(rows, gone).drop("matched")).read()
    assert rows_of(got) == rows_of(maintain.soft_delete(scans, gone).drop("matched"))


def test_empty_and_clashing_tables(spark, tmp_path):
    empty = VersionedTable.create(spark, str(tmp_path / "e"), spark.createDataFrame([], SCHEMA), "id", 4)
    assert empty.read().count() == 0
    assert rows_of(empty.upsert(spark.createDataFrame([(1, None, None)], SCHEMA)).read()) == [(1, None, None)]
    with pytest.raises(ValueError):
        VersionedTable.create(spark, str(tmp_path / "x"), spark.createDataFrame([(1, 2)], "id long, bucket int"), "id")
    with pytest.raises(FileNotFoundError):
        VersionedTable.open(spark, str(tmp_path / "nowhere"))
