"""Building blocks that keep a hot key from landing in one task.

A plain `Window.partitionBy(key)` puts every row of a key into one task. The functions
here split such a key first: by position (`number_rows`), by time (`with_time_slots`), or
by salt (`salted_join`). All of them are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

SALTS = 16
# A key with fewer rows than this is no burden for one task.
HOT_ROWS = 4_000_000
# Keys are counted in so many slots first, to see whether one of them may be hot.
SLOTS = 1 << 14


def spread(df: DataFrame) -> DataFrame:
    """Use every core for heavy per-row work on an input of only a few splits.

    A large table has far more splits than cores and is returned untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each row evaluates them exactly once.

    A later filter on a plain computed column is pushed below it and evaluates the
    expression again (for `spread` inputs even before the rows are spread). A generated
    column stays where it is.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left",
                salt_from: Sequence[str] = (), count: str | None = None,
                counts: DataFrame | None = None, salts: int = SALTS,
                hot_rows: int | None = None) -> DataFrame:
    """Equi-join in which the rows of a hot key of `big` are shared out over several tasks.

    `small` has at most one row per key and is repeated once per salt, so `how` may be
    inner, left, left_semi or left_anti. `salt_from` names columns of `big` that differ
    between the rows of one key. If `small` knows the number of rows of `big` per key
    (`count`), only keys of at least `hot_rows` rows are salted: there are no more of them
    than rows of `big` / `hot_rows`, which is what makes their broadcast safe. `counts` is a
    cheaper table with the same keys and counts, if there is one. Without counts every key
    is salted.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do a {how} join")
    salt = F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if count is None:
        left, right = big.withColumn("_salt", salt), small.withColumn("_salt", F.explode(every))
    else:
        hot = F.col(count) >= (HOT_ROWS if hot_rows is None else hot_rows)
        marks = (small if counts is None else counts).where(hot).select(*on, F.lit(True).alias("_hot"))
        left = big.join(F.broadcast(marks), list(on), "left").withColumn(
            "_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
        right = small.withColumn("_salt", F.explode(
            F.when(hot, every).otherwise(F.array(F.lit(0))))).drop(count)
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def key_slot(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def share_out(df: DataFrame, keys: Sequence[str], salt_from: Sequence[str], salts: int = SALTS,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """`df` with `_salt`, dealt so that rows of the same `keys` and `_salt` are in one task: grouped by them they are not
    moved again.

    `_salt` is 0 but for keys in a slot of `hot_rows` rows or more, as a hot key's slot is: their rows are shared out by
    `salt_from`. Slots are counted at once; there are at most SLOTS of them, whatever the number of keys.
    """
    crowded = [r["slot"] for r in df.groupBy(key_slot(keys).alias("slot")).agg(F.count("*").alias("n"))
               .where(F.col("n") >= hot_rows).collect()]
    if not crowded:
        return df.withColumn("_salt", F.lit(0)).repartition(*keys)
    salt = F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int")
    return df.withColumn("_salt", F.when(key_slot(keys).isin(crowded), salt).otherwise(0)).repartition(*keys, "_salt")


def number_rows(df: DataFrame, group: Sequence[str], position: str, out: str,
                chunk: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact 1-based row number by `position` inside `group`, without one task per large group.

    `position` is a whole number, unique in its group. Groups are counted first. One of fewer than `hot_rows` rows
    is numbered as it is. A larger one (there are at most rows / `hot_rows` of them, so their keys are
    broadcast) is cut into stretches of `chunk` positions: a running sum over the stretches' counts, one small
    row each, tells where the numbers of a stretch start.
    """
    keys = list(group)
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_rows).select(
        *keys, F.lit(True).alias("_hot"))
    cut = df.join(F.broadcast(hot), keys, "left").withColumn("_chunk", F.when(
        F.col("_hot"), whole_steps(F.col(position), chunk)).otherwise(0).cast("bigint")).drop("_hot")
    running = (Window.partitionBy(*keys).orderBy("_chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (df.join(F.broadcast(hot), keys).groupBy(*keys, whole_steps(F.col(position), chunk).alias("_chunk"))
               .agg(F.count("*").alias("_n")).withColumn("_offset", F.sum("_n").over(running)).drop("_n"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(position)
    numbered = cut.withColumn("_rn", F.row_number().over(inside))
    return (numbered.join(offsets, [*keys, "_chunk"], "left")
            .withColumn(out, (F.coalesce("_offset", F.lit(0)) + F.col("_rn")).cast("bigint"))
            .drop("_chunk", "_offset", "_rn"))


def number_all(df: DataFrame, by: Sequence[str], out: str, name: str) -> DataFrame:
    """Exact 0-based number of every row in the order of `by` (unique), written to the shared folder.

    Rows are dealt by range and sorted in their range; a range starts where the ones before end.
    There is one offset per range.
    """
    sorted_ = (df.repartitionByRange(*by).sortWithinPartitions(*by)
               .withColumn("_range", F.spark_partition_id())
               .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))))
    rows = settle(sorted_, name)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("_range").agg(F.count("*").alias("_n"))
               .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (rows.join(F.broadcast(offsets), "_range")
            .withColumn(out, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before"))


def micros(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def whole_steps(value: Column, step: int) -> Column:
    """floor(value / step) in whole numbers, also below zero."""
    return F.call_function("div", value - F.pmod(value, F.lit(step)), F.lit(step))


def slot_of(us: Column | str, span_us: int) -> Column:
    """Number of the time slot a microsecond value falls into."""
    us = F.col(us) if isinstance(us, str) else us
    return whole_steps(us, span_us)


def with_time_slots(df: DataFrame, ts: str, span_seconds: int) -> DataFrame:
    """Put each row into its own time slot and, as context, into the following one.

    A look-back of at most `span_seconds` then stays inside (key, slot), so a key is cut by
    time and no slot holds more than two spans of one key. `_own` marks the rows a slot
    answers for; `_us` is the time in microseconds.
    """
    return (df.withColumn("_us", micros(ts))
            .withColumn("_home", slot_of("_us", span_seconds * 1_000_000))
            .withColumn("_slot", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
            .withColumn("_own", F.col("_slot") == F.col("_home")))
