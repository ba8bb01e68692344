"""Sliding windows, sessions and the attempt limiter, cut by time instead of by key."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..session import scratch_path, settle
from .skew import micros, salted_join, slot_of, whole_steps, with_time_slots


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, out: str = "n_recent",
                   counted: Column | None = None) -> DataFrame:
    """Rows of the same key younger than `seconds` (strictly), the row itself included.

    With `counted` only rows for which it holds are counted.
    """
    window = (Window.partitionBy(key, "_slot").orderBy("_us")
              .rangeBetween(-(seconds * 1_000_000 - 1), 0))
    what = F.lit(1) if counted is None else counted.cast("int")
    return (with_time_slots(df, ts, seconds)
            .withColumn(out, F.sum(what).over(window))
            .where("_own").drop("_us", "_home", "_slot", "_own"))


def _busy_stretches(df: DataFrame, key: str, ts: str, failed: str, seconds: int,
                    limit: int) -> DataFrame:
    """Time spans in which a key may be blocked, one row per (key, time slot).

    A row with fewer than `limit` failures in its look-back can never be blocked. The rest
    are summed up per slot; slots less than one window apart form a stretch. Before a
    stretch no failure of the last window was blocked, so its starting state is known and
    stretches do not depend on each other.
    """
    span = seconds * 1_000_000
    counted = trailing_count(df, key, ts, seconds, "_recent", F.col(failed))
    busy = counted.where(F.col("_recent") - F.col(failed).cast("int") >= limit)
    slots = (busy.withColumn("_us", micros(ts))
             .groupBy(key, slot_of("_us", span).alias("_slot"))
             .agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi")))
    by_slot = Window.partitionBy(key).orderBy("_slot")
    opens = F.coalesce(F.col("_lo") - F.lag("_hi").over(by_slot) >= span, F.lit(True))
    marked = (slots.withColumn("_first", F.when(opens, F.col("_lo")))
              .withColumn("_start", F.max("_first").over(
                  by_slot.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_end", F.max("_hi").over(Window.partitionBy(key, "_start"))))
    # The slot before a stretch holds the failures it starts with.
    lead_in = F.when(F.col("_first").isNotNull(), F.array(F.col("_slot") - 1, F.col("_slot"))
                     ).otherwise(F.array("_slot"))
    return marked.select(key, F.explode(lead_in).alias("_slot"), "_start", "_end")


def _record(batches: Iterator[pa.RecordBatch], seconds: int, limit: int
            ) -> Iterator[pa.RecordBatch]:
    """Which failures are recorded, over rows sorted by (stretch, time, id).

    Keeps at most `limit` times in memory; while the limit is reached it jumps to the first
    row past the oldest one's expiry instead of visiting the rows between.
    """
    span, current, recent = seconds * 1_000_000, None, deque()
    for batch in batches:
        stretch = batch.column("_stretch").to_numpy(zero_copy_only=False)
        times = batch.column("_us").to_numpy(zero_copy_only=False)
        kept, i, n = [], 0, len(times)
        ends = np.append(np.flatnonzero(stretch[1:] != stretch[:-1]) + 1, n)
        while i < n:
            if stretch[i] != current:
                current = stretch[i]
                recent.clear()
            end = ends[np.searchsorted(ends, i, side="right")]
            while recent and times[i] - recent[0] >= span:
                recent.popleft()
            if len(recent) < limit:
                kept.append(i)
                recent.append(times[i])
                i += 1
            else:
                i += int(np.searchsorted(times[i:end], recent[0] + span, side="left"))
        yield batch.take(pa.array(kept, pa.int64()))


def _replay(feed: DataFrame, seconds: int, limit: int, chunk_windows: int) -> DataFrame:
    """Recorded failures of all stretches: (key, time, id) rows of `feed`.

    A long stretch is replayed chunk by chunk, `chunk_windows` windows at a time; chunk
    number n of every stretch runs in round n. What one chunk hands to the next is its
    recorded rows of the last window, at most `limit`: replayed in front of the next
    chunk they rebuild its state. Most logs need one round.
    """
    spark, span = feed.sparkSession, seconds * 1_000_000
    length = chunk_windows * span
    fed = settle(feed.withColumn("_chunk", whole_steps(
        F.greatest(F.col("_us") - F.col("_start"), F.lit(0)), length)), "limiter-feed")
    rounds = fed.agg(F.max("_chunk")).first()[0]
    path, carried = scratch_path(spark, "limiter"), None
    for n in range((rounds or 0) + 1):
        rows = fed.where(F.col("_chunk") == n)
        if carried is not None:
            rows = rows.unionByName(carried)
        ordered = rows.repartition("_stretch").sortWithinPartitions("_stretch", "_us", "_id")
        replayed = ordered.mapInArrow(lambda it: _record(it, seconds, limit), ordered.schema)
        replayed.where(F.col("_chunk") == n).write.parquet(f"{path}/round={n}")
        end = F.col("_start") + (n + 1) * length
        carried = spark.read.schema(fed.schema).parquet(f"{path}/round={n}").where(
            F.col("_us") > end - span)
    return spark.read.schema(fed.schema).parquet(*[
        f"{path}/round={n}" for n in range((rounds or 0) + 1)])


def rate_limit(df: DataFrame, key: str, ts: str, failed: str, id: str,
               seconds: int = fixed.RATE_WINDOW_SECONDS,
               limit: int = fixed.RATE_MAX_ATTEMPTS, chunk_windows: int = 96) -> DataFrame:
    """Add `blocked`: `limit` *recorded* failures are younger than `seconds`; and `remaining`,
    the failures still free before the attempt.

    A blocked attempt is not recorded, so the decision is recursive. Only the stretches in
    which blocking is possible are replayed, sorted, with a state of `limit` times; of
    failures at one instant only the first `limit` can matter. Attempts are then compared
    with the recorded failures of their own and the previous time slot, at most
    `2 * limit` of them. The replay runs when this is called; the rest is lazy.
    """
    span = seconds * 1_000_000
    slotted = (df.withColumn("_us", micros(ts))
               .withColumn("_slot", slot_of("_us", span)))
    stretches = settle(_busy_stretches(df, key, ts, failed, seconds, limit)
                       .withColumnRenamed(key, "_key"), "limiter-stretches")

    fails = slotted.where(F.col(failed)).select(
        F.col(key).alias("_key"), F.col(id).alias("_id"), "_us", "_slot")
    inside = (F.col("_us") > F.col("_start") - span) & (F.col("_us") <= F.col("_end"))
    hits = fails.join(stretches, ["_key", "_slot"]).where(inside)
    free = fails.join(stretches, (fails["_key"] == stretches["_key"])
                      & (fails["_slot"] == stretches["_slot"]) & inside, "left_anti")
    tie = Window.partitionBy("_key", "_us").orderBy("_id")
    feed = (hits.withColumn("_tie", F.row_number().over(tie))
            .where(F.col("_tie") <= limit)
            .select(F.concat_ws("@", F.col("_key").cast("string"), F.col("_start"))
                    .alias("_stretch"), "_key", "_us", "_id", "_start"))
    # A failure outside all stretches is recorded; a window holds at most `limit` of them.
    recorded = _replay(feed, seconds, limit, chunk_windows).select("_key", "_us", "_id").unionByName(
        free.select("_key", "_us", "_id"))

    home = slot_of("_us", span)
    near = (recorded.select(F.col("_key").alias(key),
                            F.explode(F.array(home, home + 1)).alias("_slot"),
                            F.struct("_us", "_id").alias("_r"))
            .groupBy(key, "_slot").agg(F.collect_list("_r").alias("_near")))
    me = F.struct(F.col("_us"), F.col(id).alias("_id"))
    active = F.size(F.filter("_near", lambda r: (r < me) & (r["_us"] > F.col("_us") - span)))
    return (salted_join(slotted, near, [key, "_slot"], "left", [id])
            .withColumn("_active", F.when(F.col("_near").isNull(), 0).otherwise(active))
            .withColumn("blocked", F.col("_active") >= limit)
            .withColumn("remaining", F.greatest(limit - F.col("_active"), F.lit(0)))
            .drop("_us", "_slot", "_near", "_active"))


def idle_sessions(df: DataFrame, key: str, ts: str, gap_seconds: int = fixed.SESSION_SECONDS,
                  warn_seconds: int = fixed.SESSION_WARNING_SECONDS) -> DataFrame:
    """Activity sessions closed by a pause of `gap_seconds`, with a long-pause flag.

    Rows are first summed up per (key, slot of one gap), where no session can end; the
    session logic then sees one small row per slot instead of every event of a busy key.
    """
    gap, warn = gap_seconds * 1_000_000, warn_seconds * 1_000_000
    slotted = (df.withColumn("_us", micros(ts))
               .withColumn("_slot", slot_of("_us", gap)))
    before = F.lag("_us").over(Window.partitionBy(key, "_slot").orderBy("_us"))
    slots = (slotted.withColumn("_pause", F.col("_us") - before).groupBy(key, "_slot")
             .agg(F.count("*").alias("_n"), F.min("_us").alias("_lo"),
                  F.max("_us").alias("_hi"), F.max("_pause").alias("_pause")))
    by_slot = Window.partitionBy(key).orderBy("_slot")
    joined = slots.withColumn("_since", F.col("_lo") - F.lag("_hi").over(by_slot))
    opens = F.coalesce(F.col("_since") >= gap, F.lit(True))
    numbered = (joined.withColumn("_opens", opens)
                .withColumn("session", F.sum(F.col("_opens").cast("int")).over(
                    by_slot.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("_pause", F.greatest(
                    F.col("_pause"), F.when(~F.col("_opens"), F.col("_since")))))
    out = numbered.groupBy(key, "session").agg(
        F.sum("_n").alias("n_events"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        F.coalesce(F.max("_pause") >= warn, F.lit(False)).alias("warned"))
    return out.select(key, "session", F.timestamp_micros("_lo").alias("session_start"),
                      F.timestamp_micros("_hi").alias("session_end"), "n_events", "warned")


def token_expiry(requests: DataFrame, uses: DataFrame, key: str, ts: str, id: str,
                 seconds: int = fixed.TOKEN_EXPIRY_SECONDS) -> DataFrame:
    """Mark each use with the latest request not older than `seconds` (strictly).

    One sorted pass per (key, time slot) over both sides; requests also enter the next
    slot. No pair of request and use is formed.
    """
    span = seconds * 1_000_000
    asked = (with_time_slots(requests, ts, seconds)
             .select(key, "_slot", "_us", F.col("_us").alias("_asked"), F.lit(0).alias("_kind"),
                     F.lit(None).cast(uses.schema[id].dataType).alias(id)))
    used = uses.withColumn("_us", micros(ts)).select(
        key, slot_of("_us", span).alias("_slot"), "_us",
        F.lit(None).cast("bigint").alias("_asked"), F.lit(1).alias("_kind"), id)
    upto = (Window.partitionBy(key, "_slot").orderBy("_us", "_kind")
            .rowsBetween(Window.unboundedPreceding, 0))
    latest = F.max("_asked").over(upto)
    return (asked.unionByName(used).withColumn("_latest", latest).where("_kind = 1")
            .withColumn("is_valid", F.coalesce(F.col("_us") - F.col("_latest") < span,
                                               F.lit(False)))
            .withColumn("age_seconds", F.when(
                F.col("is_valid"), F.floor((F.col("_us") - F.col("_latest")) / 1_000_000)))
            .select(id, key, "is_valid", "age_seconds"))


def action_windows(df: DataFrame, ts: str, action: str, width: str = "15 minutes",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Events per action and tumbling window; the same code serves batch and streams."""
    return (df.groupBy(F.window(ts, width), action, *keys).agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("window_start"), action, *keys, "n"))
