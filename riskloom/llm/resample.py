"""Importance resampling towards a target set by hashed word features.

Words of a batch are found by an Aho-Corasick automaton over the distinct words that a task has met, each
bounded by delimiters and carrying the CRC of its bytes and its length. The CRC of a run of words
follows from those of its words (`Shift`), so no run is ever written out and hashed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import chunks
from riskloom.operators.skew import number_all
from riskloom.session import settle

BUCKETS, RUN, FEWEST, PERCENT, SEED = 10_000, 1, 20, 10, 2024
# Bytes scanned at once; distinct words a task's dictionary holds and their bytes; others are hashed one by one.
WINDOW, DICTIONARY, LONGEST = 1 << 20, 1 << 17, 64
SPACE = 32
# Bytes of words: digits, letters (A-Z lower-cased) and all of UTF-8 beyond ASCII; others delimit.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else SPACE
               for b in range(256))


class Shift:
    """CRC of `first` followed by `second` from both CRCs and the length of `second`, for whole arrays.

    Appending zero bytes is linear in the CRC's bits, so there is one table of four times 256 entries
    for each power of two of bytes.
    """

    def __init__(self, powers: int = 32):
        step = np.array([self._zero_byte(1 << bit) for bit in range(32)], np.uint32)
        self.tables = []
        for _ in range(powers):
            self.tables.append(self._spread(step))
            step = self._apply(self.tables[-1], step)

    @staticmethod
    def _zero_byte(crc: int) -> int:
        # The start value and the final inversion cancel out in the difference of two CRCs.
        return zlib.crc32(b"\0", crc) ^ zlib.crc32(b"\0", 0)

    @staticmethod
    def _spread(step: np.ndarray) -> np.ndarray:
        tables = np.zeros((4, 256), np.uint32)
        values = np.arange(256)
        for bit in range(32):
            tables[bit // 8] ^= np.where(values >> bit % 8 & 1, step[bit], 0).astype(np.uint32)
        return tables

    @staticmethod
    def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return (tables[0][crc & 255] ^ tables[1][crc >> 8 & 255]
                ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24])

    def join(self, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = first.astype(np.uint32)
        for power in range(int(size.max(initial=0)).bit_length()):
            some = np.flatnonzero(size >> power & 1)
            out[some] = self._apply(self.tables[power], out[some])
        return out ^ second


class Dictionary:
    """Distinct words bounded by spaces, with CRC and length; grows with the words it is shown."""

    def __init__(self, most: int = DICTIONARY):
        self.most, self.size, self.built = most, 0, 0
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.crc, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.news: dict[bytes, int] = {}

    def scan(self, window: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, CRC and length of every word, in order; `window` starts and ends with a space."""
        ends, which = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.built:
            # Letters of one byte each: places are places of bytes.
            found = np.array(list(self.automaton.iter(window.decode("latin-1"))), np.int64).reshape(-1, 2)
            ends, which = found[:, 0], found[:, 1]
        crc, length = self.crc[which], self.length[which]
        starts = ends - length
        open_ = np.frombuffer(window, np.uint8) != SPACE
        if length.sum() == np.count_nonzero(open_):
            return starts, crc, length
        edges = np.zeros(len(window) + 1, np.int8)
        edges[starts], edges[ends] = 1, -1
        open_ &= np.cumsum(edges[:-1], dtype=np.int8) == 0
        turns = np.flatnonzero(np.diff(open_.view(np.int8))) + 1
        new_starts, new_ends = turns[::2], turns[1::2]
        words = [window[a:b] for a, b in zip(new_starts.tolist(), new_ends.tolist(), strict=True)]
        self._learn(words)
        starts = np.concatenate([starts, new_starts])
        crc = np.concatenate([crc, np.fromiter(map(zlib.crc32, words), np.uint32, len(words))])
        length = np.concatenate([length, new_ends - new_starts])
        order = np.argsort(starts, kind="stable")
        return starts[order], crc[order], length[order]

    def _learn(self, words: list[bytes]) -> None:
        for word in words:
            if self.size + len(self.news) >= self.most:
                break
            if len(word) <= LONGEST:
                self.news.setdefault(word, len(word))
        # Built again only when it has grown by a fifth: the cost stays in proportion to its size.
        if self.news and (len(self.news) * 5 >= self.size or self.size + len(self.news) >= self.most):
            for i, word in enumerate(self.news):
                self.automaton.add_word(f" {word.decode('latin-1')} ", self.size + i)
            self.crc = np.concatenate([self.crc, np.fromiter(map(zlib.crc32, self.news), np.uint32)])
            self.length = np.concatenate([self.length, np.fromiter(self.news.values(), np.int64)])
            self.size += len(self.news)
            self.built, self.news = self.size, {}
            self.automaton.make_automaton()


class Features:
    """Buckets of the features of whole texts: all runs of 1 to `run` consecutive words."""

    def __init__(self, run: int, buckets: int, most: int = DICTIONARY, window: int = WINDOW):
        self.run, self.buckets, self.window = run, buckets, window
        self.words, self.shift = Dictionary(most), Shift()

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(text, bucket) of every feature in turn, and how many of them are single words."""
        raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
        joined = b" " + b" ".join(raw.to_pylist()) + b" "
        sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(sizes + 1) - sizes
        plain, at = joined.translate(_BYTES), 0
        carried = [np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)]
        while at < len(plain) - 1:
            stop = len(plain) if at + self.window >= len(plain) else plain.rfind(b" ", at + 1, at + self.window) + 1
            if not stop:  # a word longer than the window
                stop = plain.index(b" ", at + self.window) + 1
            starts, crc, length = self.words.scan(plain[at:stop])
            text = np.searchsorted(first, starts + at, side="right") - 1
            before = len(carried[0])
            row = [np.concatenate(pair) for pair in zip(carried, (text, crc, length), strict=True)]
            yield from self._runs(row, before)
            carried = [column[max(0, len(column) - self.run + 1):] for column in row]
            at = stop - 1

    def _runs(self, row: list[np.ndarray], before: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        text, crc, length = row
        yield text[before:], (crc[before:] % self.buckets).astype(np.int64), len(text) - before
        if self.run == 1 or not len(text):
            return
        spaced = self.shift.join(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, length)
        runs = crc
        for size in range(2, self.run + 1):
            runs = self.shift.join(runs[:-1], spaced[size - 1:], length[size - 1:] + 1)
            # Runs that end among the new words; those before were given out with the last window.
            new = max(0, before - size + 1)
            same = text[new:len(runs)] == text[new + size - 1:]
            yield text[new:len(runs)][same], (runs[new:][same] % self.buckets).astype(np.int64), 0
            if not len(runs):
                return


def count_buckets(rows: DataFrame, text: str, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task hands over one row per bucket."""

    def count(batches):
        features, total = Features(run, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in chunks.slices(batch.column(0), WINDOW):
                for _, bucket, _ in features.of(part):
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    found = rows.select(F.col(text).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of how much likelier the target has the bucket), with one added to each count."""
    of_source, of_target = (float(counts.sum() + len(counts)) for counts in (source, target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_source / ((s + 1.0) * of_target)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean gain of each text's features, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches):
        gain = shared.value
        features = Features(run, len(gain))
        for batch in batches:
            for at, part in chunks.slices(batch.column(1), WINDOW):
                words, count, total = (np.zeros(len(part), np.int64) for _ in range(3))
                for row, bucket, single in features.of(part):
                    n = np.bincount(row, minlength=len(part))
                    count += n
                    words += n if single else 0
                    # Whole numbers far below 2**53: the sums are exact.
                    total += np.bincount(row, gain[bucket], len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(words), pa.array(count),
                     pa.array(total // np.maximum(count, 1))], names=["key", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(score, "key bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text",
             target_text: str = "text", run: int = RUN, buckets: int = BUCKETS, fewest: int = FEWEST,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of `docs`; rank is null where it is not drawn.

    Words are runs of digits, letters and characters beyond ASCII; only A-Z are lower-cased. Features are all
    runs of 1 to `run` consecutive words, joined by one space and counted as often as they occur; a feature's bucket is
    its CRC modulo `buckets`. `weight` is the floored mean of `gains`. `score` adds a Gumbel
    draw that depends on `seed` and `key` alone. Of the rows with at least `fewest` words the
    `percent` per cent with the highest scores are drawn, ties by smaller key.

    Null and empty texts have no features and weight 0. A null key draws as an empty one and comes
    last among ties; rows that repeat a key are ranked each on its own. An empty `docs` gives no
    rows, an empty `target` counts nothing. Other columns are not read. The driver sees one number per bucket;
    texts are scanned twice and never moved; only (key, score) rows are sorted, by range.
    """
    gain = gains(count_buckets(docs, text, run, buckets), count_buckets(target, target_text, run, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))),
                                  256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = settle(weigh(docs, gain, key, text, run).withColumn("score", F.col("weight") + luck), "scored")
    able = F.col("n_words") >= fewest
    ranked = number_all(scored.where(able).withColumns({"down": -F.col("score"), "last": F.col("key").isNull()}),
                        ["down", "last", "key"], "place", "ranked")
    drawn = ranked.count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    columns = [F.col("key").alias(key), "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(
        scored.where(~able).select(*columns, F.lit(None).cast("bigint").alias("rank")))
