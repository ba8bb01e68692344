"""Activity sessions and token expiry as streams with the same answers as their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed

SESSION_FIELDS = ("session bigint, session_start timestamp, session_end timestamp, n_events bigint, warned boolean")


class Sessions(StatefulProcessor):
    """State per key: the session that is open, and the distinct times that the watermark has not passed yet.

    Times are taken in order once no earlier one can come, so late rows within the watermark's delay
    count as in a batch. A session is given out when the watermark has passed its last time by the pause.
    """

    def __init__(self, key: str, ts: str, gap_seconds: int, warn_seconds: int):
        self.key, self.ts = key, ts
        self.gap, self.warn = gap_seconds * 1_000_000, warn_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us bigint", "n bigint")
        self.open = handle.getValueState("open", "session bigint, lo bigint, hi bigint, n bigint, pause bigint")
        self.count = handle.getValueState("count", "sessions bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:  # Arrow batch by Arrow batch, never a whole micro-batch
            times = part[self.ts].dropna().astype("datetime64[us]").astype("int64")
            for us, n in times.value_counts().items():
                known = self.waiting.getValue((int(us),)) if self.waiting.containsKey((int(us),)) else None
                self.waiting.updateValue((int(us),), (int(n) + (known[0] if known else 0),))
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues)

    def _advance(self, key, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        now = self.open.get() if self.open.exists() else None
        closed = []
        for (us,) in sorted(k for k in self.waiting.keys() if k[0] <= passed):
            (n,) = self.waiting.getValue((us,))
            self.waiting.removeKey((us,))
            if now is not None and us - now[2] < self.gap:
                pauses = [p for p in (now[4], us - now[2], 0 if n > 1 else None) if p is not None]
                now = (now[0], now[1], us, now[3] + n, max(pauses))
            else:
                if now is not None:
                    closed.append(now)
                number = (self.count.get()[0] if self.count.exists() else 0) + 1
                self.count.update((number,))
                now = (number, us, us, n, 0 if n > 1 else None)
        if now is not None and now[2] + self.gap <= passed:
            closed.append(now)
            now = None
        due = [k[0] for k in self.waiting.keys()]
        if now is None:
            self.open.clear()
        else:
            self.open.update(now)
            due.append(now[2] + self.gap)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        if closed:
            frame = pd.DataFrame(closed, columns=["session", "lo", "hi", "n_events", "pause"])
            yield pd.DataFrame({
                self.key: [key[0]] * len(frame), "session": frame["session"],
                "session_start": pd.to_datetime(frame["lo"], unit="us"),
                "session_end": pd.to_datetime(frame["hi"], unit="us"), "n_events": frame["n_events"],
                "warned": [p is not None and p >= self.warn for _, _, _, _, p in closed]})

    def close(self) -> None:
        pass


def idle_sessions_stream(df: DataFrame, key: str, ts: str, gap_seconds: int = fixed.SESSION_SECONDS,
                         warn_seconds: int = fixed.SESSION_WARNING_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """Closed sessions of a stream, as `limits.idle_sessions` gives them: number, start, end, events, long pause.

    Needs the RocksDB state store provider. A key keeps its open session, the times of the last `delay` and its
    number of sessions.
    """
    out = T.StructType([df.schema[key], *T._parse_datatype_string(SESSION_FIELDS).fields])
    return df.select(key, ts).withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=Sessions(key, ts, gap_seconds, warn_seconds), outputStructType=out,
        outputMode="Append", timeMode="EventTime")


def token_expiry_stream(requests: DataFrame, uses: DataFrame, key: str, ts: str, id: str,
                        seconds: int = fixed.TOKEN_EXPIRY_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Each use with the latest request of its key not older than `seconds`, as `limits.token_expiry` gives it.

    Both sides have a watermark and the join is bounded in time: a request leaves the state `seconds` and
    the delay after it was made, a use when it is answered. A use is answered once no request for it can come.
    """
    asked = requests.select(F.col(key).alias("_key"), F.col(ts).alias("_asked")).withWatermark("_asked", delay)
    used = uses.select(key, ts, id).withWatermark(ts, delay)
    young = F.expr(f"`{ts}` >= _asked AND `{ts}` < _asked + INTERVAL {seconds} SECONDS")
    joined = used.join(asked, (F.col(key) == F.col("_key")) & young, "leftOuter")
    latest = joined.groupBy(ts, key, id).agg(F.max("_asked").alias("_latest"))
    age = F.unix_micros(ts) - F.unix_micros("_latest")
    return latest.select(id, key, F.col("_latest").isNotNull().alias("is_valid"),
                         F.floor(age / 1_000_000).alias("age_seconds"))
