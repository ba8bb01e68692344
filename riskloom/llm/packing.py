"""Pack tokenized documents into sequences of fixed size by fitted length patterns.

The histogram of piece lengths (at most `size` counts, whatever the corpus) is all the driver
sees. Lengths are put into bins; patterns of a few bins that fill a sequence are enumerated, and
their repeat counts are fitted to the histogram by non-negative least squares and rounded down.
Each repeat draws real lengths, the
longest of each bin and at the end the longest that still fits. What is left, small pieces among it, goes best-fit
into the gaps and into new sequences, again on counts. The result is a list of *runs*: so many
pieces of one length go to so many sequences at such an offset. Pieces are numbered within
their length in parallel, and the number tells the run.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import chunks
from riskloom.session import settle

SIZE = 4096
BINS = 64
DOCS_IN_PATTERN = 4
# Pieces of at most this many bins are kept to fill gaps.
SMALL_BINS = 4
# Rows of one length that are numbered in one task.
NUMBERED = 100_000


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = SIZE,
               key: str = "doc_id", text: str = "text", remembered: int = chunks.KEPT) -> DataFrame:
    """(key, piece, start, length, ids_crc32): ids of whole texts and `end_id`, cut every `size` ids."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast((file.read(), remembered))

    def cut(batches):
        encoder = chunks.opened(chunks.encoder, spec.value)
        for batch in batches:
            for at, part in chunks.slices(batch.column(1), chunks.WORK_BYTES):
                ids, starts = encoder.ids(part)
                n = len(part)
                edges = starts + np.arange(n + 1)
                whole = np.full(edges[-1], end_id, "<u4")
                keep = np.ones(edges[-1], bool)
                keep[edges[1:] - 1] = False
                whole[keep] = ids
                total = np.diff(edges)
                pieces = -(-total // size)
                row = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                length = np.minimum(total[row] - start, size)
                raw, first = memoryview(whole.tobytes()), edges[row] + start
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in
                       zip(first.tolist(), (first + length).tolist(), strict=True)]
                keys = batch.column(0).slice(at, n).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(bins: int = BINS, most: int = DOCS_IN_PATTERN, least: int = SMALL_BINS + 1) -> list[tuple[int, ...]]:
    """All falling tuples of at most `most` bins of at least `least` that fill a sequence."""
    found: list[tuple[int, ...]] = []

    def extend(have: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(have)
        elif len(have) < most:
            for b in range(min(left, have[-1] if have else bins), least - 1, -1):
                extend((*have, b), left - b)

    extend((), bins)
    return found


def fit(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |matrix x - target|, by growing and shrinking a set of free columns."""
    gram, goal = matrix.T @ matrix, matrix.T @ target
    x = np.zeros(len(goal))
    free = np.zeros(len(goal), bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(goal).max(initial=0)))
    for _ in range(4 * len(target)):
        gain = np.where(free, -np.inf, goal - gram @ x)
        best = int(np.argmax(gain))
        if gain[best] <= tolerance:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            trial = np.linalg.lstsq(gram[np.ix_(at, at)], goal[at], rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            falling = trial <= 0
            now = x[at]
            step = np.min(now[falling] / np.maximum(now[falling] - trial[falling], 1e-300))
            x[at] = now + step * (trial - now)
            gone = at[falling & (x[at] <= 1e-12)]
            if not len(gone):
                gone = at[falling][:1]
            x[gone] = 0
            free[gone] = False
            if not free.any():
                break
    return x


@dataclass
class Group:
    """`count` sequences alike: runs of (length, pieces in each sequence), and the room left."""

    count: int
    room: int
    runs: list[tuple[int, int]] = field(default_factory=list)

    def part(self, count: int) -> Group:
        self.count -= count
        return Group(count, self.room, list(self.runs))

    def add(self, length: int, pieces: int) -> None:
        self.runs.append((length, pieces))
        self.room -= length * pieces


def plan(counts: dict[int, int], size: int = SIZE) -> list[Group]:
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    groups = _repeat_patterns(left, size)
    _best_fit(left, groups, size)
    return groups


def _repeat_patterns(left: np.ndarray, size: int) -> list[Group]:
    """Take from `left` what the fitted patterns use."""
    bins = min(BINS, size)
    width = size / bins
    bin_of = np.ceil(np.arange(size + 1) / width).astype(int)
    histogram = np.bincount(bin_of, left, bins + 1)[1:]
    shapes = patterns(bins, least=min(SMALL_BINS + 1, bins))
    matrix = np.array([np.bincount(s, minlength=bins + 1)[1:] for s in shapes], float).T
    histogram[: SMALL_BINS] = 0
    repeats = np.floor(fit(matrix, histogram) + 1e-9).astype(np.int64)
    groups = []
    longest = [np.flatnonzero(bin_of == b)[::-1] for b in range(bins + 1)]
    for i in np.argsort(-repeats, kind="stable"):
        wanted = int(repeats[i])
        while wanted > 0:
            drawn: list[int] = []
            for b in shapes[i][:-1]:
                there = longest[b][left[longest[b]] > [drawn.count(int(x)) for x in longest[b]]]
                if not len(there):
                    break
                drawn.append(int(there[0]))
            if len(drawn) < len(shapes[i]) - 1:
                break
            # The last piece is the longest that still fits; its bin is at least the pattern's.
            fitting = left[: size - sum(drawn) + 1].copy()
            for x in drawn:
                if x < len(fitting):
                    fitting[x] -= 1
            there = np.flatnonzero(fitting > 0)
            if not len(there) or bin_of[there[-1]] < shapes[i][-1]:
                break
            drawn.append(int(there[-1]))
            n = min(wanted, *(int(left[x]) // drawn.count(x) for x in set(drawn)))
            group = Group(n, size)
            for x in drawn:
                group.add(x, 1)
                left[x] -= n
            groups.append(group)
            wanted -= n
    return groups


def _best_fit(left: np.ndarray, groups: list[Group], size: int) -> None:
    """Longest first, each piece goes where the least room is left; all alike at once."""
    rooms: list[list[Group]] = [[] for _ in range(size + 1)]
    for group in groups:
        rooms[group.room].append(group)
    filled = np.array([bool(r) for r in rooms])

    def put(group: Group) -> None:
        rooms[group.room].append(group)
        filled[group.room] = True

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            ahead = filled[length:]
            at = int(np.argmax(ahead))
            if ahead[at]:
                group = rooms[length + at].pop()
                filled[length + at] = bool(rooms[length + at])
            else:
                group = Group(-(-n // (size // length)), size)
                groups.append(group)
            each = group.room // length
            full = min(group.count, n // each)
            if full < group.count:  # the rest of the group keeps its room
                if full:
                    rest, group = group, group.part(full)
                    groups.append(group)
                    put(rest)
                else:
                    if group.count > 1:
                        rest, group = group, group.part(1)
                        groups.append(group)
                        put(rest)
                    each = n
            group.add(length, each)
            n -= each * group.count
            put(group)
        left[length] = 0


def layout(groups: list[Group]) -> tuple[dict[int, int], dict[str, np.ndarray]]:
    """First number of each length, and the runs by the number of their first piece."""
    rows, used, sequence = [], {}, 0
    for group in groups:
        offset = 0
        for length, each in group.runs:
            if group.count and each:
                rows.append((length, used.get(length, 0), sequence, group.count, offset))
                used[length] = used.get(length, 0) + each * group.count
            offset += length * each
        sequence += group.count
    base, at = {}, 0
    for length in sorted(used):
        base[length], at = at, at + used[length]
    rows = sorted((base[length] + first, length, seq, n, offset) for length, first, seq, n, offset in rows)
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return base, dict(zip(("first", "length", "sequence", "count", "offset"), columns, strict=True))


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to settled `pieces` (with key, piece, length)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    base, runs = layout(plan(counts, size))
    shared = spark.sparkContext.broadcast(runs)
    # One row per length, `size` at most.
    shares = spark.createDataFrame(
        [(length, base[length], -(-n // NUMBERED)) for length, n in counts.items()],
        "length bigint, _base bigint, _shares bigint")
    dealt = pieces.join(F.broadcast(shares), "length").withColumn(
        "_share", F.pmod(F.xxhash64("key", "piece"), F.col("_shares")))
    # One row per share, that is one per length and one more per NUMBERED rows.
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("length", "_share").agg(F.count("*").alias("_n"))
               .select("length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("length", "_share").orderBy("key", "piece", "ids_crc32")
    numbered = (dealt.withColumn("_row", F.row_number().over(inside) - 1).join(offsets, ["length", "_share"])
                .select("key", "piece", "start", "length", "ids_crc32",
                        (F.col("_base") + F.col("_before") + F.col("_row")).alias("_number")))

    def slots(batches):
        runs = shared.value
        for batch in batches:
            number = batch.column(5).to_numpy()
            at = np.searchsorted(runs["first"], number, side="right") - 1
            inside = number - runs["first"][at]
            sequence = runs["sequence"][at] + inside % runs["count"][at]
            offset = runs["offset"][at] + inside // runs["count"][at] * runs["length"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(slots, "key bigint, piece int, start bigint, length bigint, "
                               "ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = SIZE,
         key: str = "doc_id", text: str = "text", remembered: int = chunks.KEPT) -> DataFrame:
    """One row per piece with its sequence and place; only texts of more than `size` ids are cut.

    Null text is empty (the end id alone); null keys and repeated rows are packed like any
    other; ties among equal lengths are broken by key and piece; an empty table gives no rows;
    other columns are not read. The ids are made once; their lengths are written down. A worker remembers
    the ids of at most twice `remembered` chunks: fewer cost time, more cost memory, the rows stay the same.
    """
    pieces = settle(cut_pieces(docs, tokenizer_path, end_id, size, key, text, remembered), "pieces")
    return place(pieces, size).withColumnRenamed("key", key)
