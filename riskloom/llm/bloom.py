"""Bloom filters of bounded size, to keep wide rows that cannot match out of a shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits per key and the most bits; beyond it the filter lets more through, which costs time only.
BITS, MOST_BITS, TRIES = 10, 1 << 27, 4


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        a = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(32)
        b = (a * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        return [(((a + np.uint64(i) * b) >> np.uint64(20)) % np.uint64(bits)).astype(np.int64) for i in range(TRIES)]


def build(keys: DataFrame, column: str) -> np.ndarray:
    """The filter of all non-null keys as packed bits (16 MB at most)."""
    count = keys.where(F.col(column).isNotNull()).count()
    bits = min(MOST_BITS, max(1 << 10, 1 << int(np.ceil(np.log2(max(1, count * BITS))))))

    def mark(batches):
        out = np.zeros(bits, bool)
        for batch in batches:
            for place in _places(batch.column(0).to_numpy(), bits):
                out[place] = True
        packed = np.packbits(out)
        step = 1 << 16
        pieces = [packed[i:i + step].tobytes() for i in range(0, len(packed), step)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())],
                                         names=["part", "bits"])

    def join_bits(batches):
        now, bits_of = None, None
        for batch in batches:
            for part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, np.uint8)
                if part != now:
                    if now is not None:
                        yield _row(now, bits_of)
                    now, bits_of = part, own.copy()
                else:
                    bits_of |= own
        if now is not None:
            yield _row(now, bits_of)

    def _row(part, bits_of):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits_of.tobytes()], pa.binary())],
                                          names=["part", "bits"])

    tasks = max(1, min(64, count // 100_000))
    marked = (keys.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint")).coalesce(tasks)
              .mapInArrow(mark, "part int, bits binary"))
    rows = (marked.repartition("part").sortWithinPartitions("part")
            .mapInArrow(join_bits, "part int, bits binary").collect())
    whole = b"".join(r["bits"] for r in sorted(rows))
    return np.unpackbits(np.frombuffer(whole, np.uint8)).astype(bool) if whole else np.zeros(1 << 10, bool)


def may_hold(keys: DataFrame, column: str, tested: str) -> Column:
    """False only where `tested` (bigint) surely is not among the keys; false for null."""
    shared = keys.sparkSession.sparkContext.broadcast(np.packbits(build(keys, column)))

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        packed = shared.value
        known = values.notna().to_numpy()
        own = values.fillna(0).to_numpy().astype(np.int64)
        for place in _places(own, 8 * len(packed)):
            known &= (packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0
        return pd.Series(known)

    return test(F.col(tested))
