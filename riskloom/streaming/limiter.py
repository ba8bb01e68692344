"""The attempt limiter as a keyed stateful stream (same answer as the batch form)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_all().to_pandas()


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def decide(times: np.ndarray, failed: np.ndarray, recent: list[int], span: int, limit: int
           ) -> tuple[np.ndarray, list[int]]:
    """Recorded failures younger than `span` before each row, and those left at the end.

    `times` ascend; `recent` are at most `limit` recorded failures from before. While the
    limit is reached, all failures up to the oldest one's expiry are passed over at once.
    """
    tried = np.flatnonzero(failed)
    at = times[tried]
    live, kept, i = list(recent), [], 0
    while i < len(tried):
        live = [t for t in live if at[i] - t < span]
        if len(live) < limit:
            kept.append(i)
            live.append(int(at[i]))
            i += 1
        else:
            i = int(np.searchsorted(at, live[0] + span, side="left"))
    places = np.concatenate([np.full(len(recent), -1, np.int64), tried[kept]])
    moments = np.concatenate([np.array(recent, np.int64), at[kept]])
    active = (np.searchsorted(places, np.arange(len(times)), side="left")
              - np.searchsorted(moments, times - span, side="right"))
    return np.maximum(active, 0), moments[-limit:].tolist()


class Limiter(StatefulProcessor):
    """State per key: rows of time slots still open, and at most `limit` recorded failures.

    Arriving rows go to their slot in packed pieces, whatever order they come in. When the
    watermark has passed a slot, a timer drains it in order of time, so that memory is
    bounded by the rows of one key and slot, not by a micro-batch.
    """

    def __init__(self, ts: str, failed: str, id: str, seconds: int, limit: int,
                 slot_seconds: int):
        self.ts, self.failed, self.id = ts, failed, id
        self.span, self.limit = seconds * 1_000_000, limit
        self.width = slot_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        slot, piece = T.StructField("slot", T.LongType()), T.StructField("piece", T.IntegerType())
        self.recent = handle.getListState(
            "recent", T.StructType([T.StructField("us", T.LongType())]))
        self.pieces = handle.getMapState("pieces", T.StructType([slot]), T.StructType([piece]))
        self.rows = handle.getMapState("rows", T.StructType([slot, piece]),
                                       T.StructType([T.StructField("blob", T.BinaryType())]))
        self.handle = handle

    def _at(self, ms: int) -> None:
        if ms not in set(self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            for slot, part in chunk.groupby(_micros(chunk[self.ts]) // self.width):
                slot = int(slot)
                known = self.pieces.containsKey((slot,))
                n = self.pieces.getValue((slot,))[0] if known else 0
                self.rows.updateValue((slot, n), (_packed(part),))
                self.pieces.updateValue((slot,), (n + 1,))
                if not known:
                    self._at((slot + 1) * self.width // 1000)
        return iter([])

    def _drained(self, slot: int, recent: list[int]) -> tuple[pd.DataFrame, list[int]]:
        blobs = []
        for piece in range(self.pieces.getValue((slot,))[0]):
            blobs.append(_unpacked(self.rows.getValue((slot, piece))[0]))
            self.rows.removeKey((slot, piece))
        self.pieces.removeKey((slot,))
        batch = pd.concat(blobs).sort_values([self.ts, self.id], kind="stable")
        active, recent = decide(_micros(batch[self.ts]),
                                batch[self.failed].eq(True).to_numpy(bool), recent,
                                self.span, self.limit)
        return batch.assign(blocked=active >= self.limit,
                            remaining=np.maximum(self.limit - active, 0).astype("int32")), recent

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        slots = [slot for slot, in list(self.pieces.keys())] if self.pieces.exists() else []
        closed = sorted(s for s in slots if (s + 1) * self.width <= now)
        recent = [us for us, in self.recent.get()] if self.recent.exists() else []
        for slot in closed:
            batch, recent = self._drained(slot, recent)
            yield batch
        last = slots and min(set(slots) - set(closed), default=None)
        if recent and recent[-1] + self.span <= now and not last:
            recent = []
        if recent:
            self.recent.put([(us,) for us in recent])
            self._at((max(recent[-1] + self.span, now)) // 1000 + 1)
        else:
            self.recent.clear()

    def close(self) -> None:
        pass


def rate_limit_stream(df: DataFrame, key: str, ts: str, failed: str, id: str,
                      seconds: int = fixed.RATE_WINDOW_SECONDS,
                      limit: int = fixed.RATE_MAX_ATTEMPTS, delay: str = "0 seconds",
                      slot_seconds: int = 60) -> DataFrame:
    """Add `blocked` and `remaining` to a stream of attempts, in order of (time, id).

    An attempt is answered once the watermark (newest time less `delay`) has passed its slot
    of `slot_seconds`; until then rows that arrive late, in any micro-batch, are still put in
    order. Rows later than the watermark and rows without a time are left out; a null outcome
    is no failure; repeated rows are separate attempts. Columns are of plain types, not structs.
    Needs the RocksDB state store provider. Idle keys leave the state by an event-time timer
    once their newest failure has expired.
    """
    out = T.StructType(df.schema.fields + [T.StructField("blocked", T.BooleanType()),
                                           T.StructField("remaining", T.IntegerType())])
    return df.where(F.col(ts).isNotNull()).withWatermark(ts, delay).groupBy(
        key).transformWithStateInPandas(
        statefulProcessor=Limiter(ts, failed, id, seconds, limit, slot_seconds),
        outputStructType=out, outputMode="Append", timeMode="EventTime")
