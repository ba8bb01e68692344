"""A linear classifier trained in rounds of Spark tasks over a written sparse feature table.

Features are hashed tokens and bigrams, so their number is fixed and the driver holds a few vectors of
that length, whatever the corpus. Rows are kept in packed blocks (`BLOCK`), which a task reads without a copy per
row or feature. A round sends the weights to the tasks; each goes through its blocks once and hands back its
gradient and its part of the losses and counts as whole numbers (`UNIT`), which Spark adds up exactly
and in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

FEATURE_BITS = 18
ITERATIONS, RATE, REG = 50, 0.05, 1e-4
# Features of rows that are worked on at once, the unit of summed means, and the numbers in one row of summed vectors.
FEATURES_AT_ONCE, MOST_ROWS, UNIT, STRETCH = 1 << 18, 1 << 16, 2.0 ** 40, 1 << 15
CLIP = 1e-7
# Rows of one run: whether each is a training row and a positive, and its length; then, in the order of the features, each
# distinct feature of each row: the step from the feature before, the row and how often. Steps and counts over 255 are named
# apart, by place. In this order a round goes through its vectors of all features from one end to the other.
BLOCK = {"train": np.uint8, "positive": np.uint8, "norm": np.float64, "row": np.uint16,
         "step": np.uint8, "step_at": np.int32, "step_to": np.int32,
         "counts": np.uint8, "counts_at": np.int32, "counts_to": np.int32}
# What a task reports behind its gradient.
BIAS, LOSSES, COUNTS, TOLD = 0, (1, 2), {"train": (3, 4, 5, 6), "val": (7, 8, 9, 10)}, 11
EPOCH_SCHEMA = ("epoch int, train_loss double, train_accuracy double, val_loss double, val_accuracy double, "
                "f1 double, loss double, is_best boolean")


@dataclass(frozen=True)
class LinearScorer:
    """Weight and inverse document frequency of each feature, and the rounds that led to them."""

    bits: int
    inverse: np.ndarray
    weights: np.ndarray
    bias: float
    epochs: tuple[dict, ...] = ()

    def epoch_table(self, spark: SparkSession) -> DataFrame:
        names = [part.split()[0] for part in EPOCH_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(e[n] for n in names) for e in self.epochs], EPOCH_SCHEMA)


def hashed_features(tokens: str, bits: int = FEATURE_BITS) -> Column:
    """Feature numbers of all tokens and all pairs of neighbours of a row, in turn, repeats included."""
    size, words = 2 ** bits, F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    inner = F.greatest(F.size(words) - 1, F.lit(0))
    one = F.transform(words, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    two = F.zip_with(F.slice(words, 1, inner), F.slice(words, 2, inner),
                     lambda a, b: (F.pmod(F.xxhash64(a, b), F.lit(size)) + size).cast("int"))
    return F.concat(one, two)


def _runs(lists: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of `MOST_ROWS` rows at most with about `FEATURES_AT_ONCE` list entries, with their start."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(lists):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + MOST_ROWS, int(np.searchsorted(ends, before + FEATURES_AT_ONCE, side="right"))))
        yield at, lists.slice(at, stop - at)
        at = stop


def _counted(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, row and count of every distinct feature of every row, in this order."""
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    both, n = np.unique(ids * len(lists) + np.repeat(np.arange(len(lists)), sizes), return_counts=True)
    return both // len(lists), both % len(lists), n


def _lengths(row: np.ndarray, feature: np.ndarray, n: np.ndarray, inverse: np.ndarray, rows: int) -> np.ndarray:
    """The length of each row's values: count x inverse frequency. Divided by it, all rows are equally long."""
    return np.sqrt(np.bincount(row, (n * inverse[feature]) ** 2, rows))


def _pack(feature: np.ndarray, **parts: np.ndarray) -> pa.RecordBatch:
    for name, values in (("step", np.diff(feature, prepend=0)), ("counts", parts["counts"])):
        large = np.flatnonzero(values > 255)
        parts |= {name: np.minimum(values, 255), f"{name}_at": large, f"{name}_to": values[large]}
    return pa.RecordBatch.from_pydict({
        name: pa.array([parts[name].astype(kind, copy=False).tobytes()], pa.binary()) for name, kind in BLOCK.items()})


def _unpacked(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    for i in range(len(batch)):
        block = {name: np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in BLOCK.items()}
        for name in ("step", "counts"):
            block[name] = block[name].astype(np.int64)
            block[name][block[f"{name}_at"]] = block[f"{name}_to"]
        block["feature"], block["row"] = np.cumsum(block["step"]), block["row"].astype(np.int64)
        yield block


def _blocks(df: DataFrame, work) -> DataFrame:
    schema = ", ".join(f"{name} binary" for name in BLOCK)
    return df.mapInArrow(work, schema)


def packed_rows(rows: DataFrame) -> DataFrame:
    """(is_train, label, features) in blocks, lengths not filled in yet."""
    def pack(batches):
        for batch in batches:
            for at, lists in _runs(batch.column(2)):
                feature, row, n = _counted(lists)
                yield _pack(feature, row=row, counts=n, norm=np.zeros(len(lists)),
                            train=batch.column(0).slice(at, len(lists)).to_numpy(zero_copy_only=False),
                            positive=batch.column(1).slice(at, len(lists)).to_numpy(zero_copy_only=False) == 1)

    return _blocks(rows.select("is_train", "label", "features"), pack)


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' vectors, which come as rows (place, values) of `STRETCH` whole numbers."""
    def add(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(v.as_buffer(), np.int64) for v in table.column("values")]
        return pa.table({"place": table.column("place").slice(0, 1).cast(pa.int32()),
                         "values": pa.array([np.sum(found, axis=0).tobytes()], pa.binary())})

    told = parts.groupBy("place").applyInArrow(add, "place int, values binary").toArrow().sort_by("place")
    if not len(told):
        return np.zeros(0, np.int64)
    return np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in told.column("values")])


def _stretches(vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    for place, at in enumerate(range(0, len(vector), STRETCH)):
        yield pa.RecordBatch.from_arrays(
            [pa.array([place], pa.int32()), pa.array([vector[at:at + STRETCH].astype(np.int64).tobytes()], pa.binary())],
            names=["place", "values"])


def _gather(table: DataFrame, work) -> np.ndarray:
    return _added(table.mapInArrow(work, "place int, values binary"))


def inverse_frequencies(table: DataFrame, bits: int, least: int = 2) -> tuple[np.ndarray, dict]:
    """log((rows + 1) / (rows with the feature + 1)) over training rows, 0 for features of fewer than `least` rows,
    and the number of rows by (is_train, positive)."""
    def count(batches):
        held, kinds = np.zeros(2 << bits, np.int64), np.zeros(4, np.int64)
        for batch in batches:
            for block in _unpacked(batch):
                held += np.bincount(block["feature"][block["train"][block["row"]] == 1], minlength=len(held))
                kinds += np.bincount(block["train"] * 2 + block["positive"], minlength=4)
        yield from _stretches(np.concatenate([kinds, held]))

    told = _gather(table, count)
    kinds, held = (told[:4], told[4:]) if len(told) else (np.zeros(4, np.int64), np.zeros(2 << bits, np.int64))
    n = kinds[2] + kinds[3]
    rows = {(bool(i >> 1), bool(i & 1)): int(k) for i, k in enumerate(kinds)}
    return np.where(held >= least, np.log((n + 1) / (held + 1)), 0.0), rows


def weighed(table: DataFrame, inverse: np.ndarray) -> DataFrame:
    """The blocks with their rows' lengths, without features that have no inverse frequency."""
    shared = table.sparkSession.sparkContext.broadcast(inverse)

    def weigh(batches):
        for batch in batches:
            for block in _unpacked(batch):
                used = shared.value[block["feature"]] > 0
                feature, row, n = (block[name][used] for name in ("feature", "row", "counts"))
                norm = _lengths(row, feature, n, shared.value, len(block["norm"]))
                yield _pack(feature, row=row, counts=n, norm=norm, train=block["train"], positive=block["positive"])

    return _blocks(table, weigh)


def _pass(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float, inverse: np.ndarray,
          positive: float, sizes: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """One task's part of a round over blocks."""
    gradient, sums, counts = np.zeros(len(weights)), np.zeros(TOLD), np.zeros(TOLD, np.int64)
    pulls = weights * inverse
    for batch in batches:
        for block in _unpacked(batch):
            row, ids, n = block["row"], block["feature"], len(block["norm"])
            train, label = block["train"] == 1, block["positive"] == 1
            scale = np.divide(1, block["norm"], out=np.zeros(n), where=block["norm"] > 0)
            p = 1 / (1 + np.exp(-(np.bincount(row, block["counts"] * pulls[ids], n) * scale + bias)))
            share = np.where(label, positive, 1.0)
            error = np.where(train, share * (p - label), 0.0)
            np.add.at(gradient, ids, block["counts"] * (error * scale)[row])
            sums[BIAS] += error.sum()
            loss = -share * np.log(np.clip(np.where(label, p, 1 - p), CLIP, 1))
            for mine, which, name in ((train, LOSSES[0], "train"), (~train, LOSSES[1], "val")):
                sums[which] += loss[mine].sum()
                said, true = p[mine] >= 0.5, label[mine]
                for key, part in zip(COUNTS[name], (said & true, ~said & ~true, said & ~true, ~said & true),
                                     strict=True):
                    counts[key] += int(part.sum())
    means = np.ones(TOLD)
    means[[BIAS, *LOSSES]] = max(1, sizes[0]), max(1, sizes[0]), max(1, sizes[1])
    yield from _stretches(np.concatenate([np.rint(gradient * inverse / max(1, sizes[0]) * UNIT).astype(np.int64),
                                          np.rint(sums / means * UNIT).astype(np.int64) + counts]))


def _round(rows: DataFrame, scorer: LinearScorer, positive: float, sizes: tuple[int, int]
           ) -> tuple[np.ndarray, np.ndarray]:
    """Gradient at the scorer's weights, and what else the tasks report."""
    shared = rows.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias, scorer.inverse))
    told = _gather(rows, lambda batches: _pass(batches, *shared.value, positive, sizes))
    shared.destroy()
    if not len(told):
        told = np.zeros(len(scorer.weights) + TOLD, np.int64)
    return told[:-TOLD] / UNIT, told[-TOLD:]


def _epoch(number: int, told: np.ndarray) -> dict:
    (a, b, c, d), (tp, tn, fp, fn) = ([int(told[key]) for key in COUNTS[name]] for name in ("train", "val"))
    losses = [float(told[key] / UNIT) for key in LOSSES]
    return {"epoch": number, "train_loss": losses[0], "train_accuracy": (a + b) / max(1, a + b + c + d),
            "val_loss": losses[1], "val_accuracy": (tp + tn) / max(1, tp + tn + fp + fn),
            "f1": 2 * tp / max(1, 2 * tp + fp + fn), "loss": losses[1], "is_best": False}


def steps(gradients, size: int, rate: float, reg: float) -> Iterator[tuple[np.ndarray, float]]:
    """Weights and bias before each round; `gradients` tells the gradient of what it is shown.

    Adam with decoupled decay of the weights (not of the bias).
    """
    both, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    step = 0
    while True:
        yield both[:-1], float(both[-1])
        step += 1
        slope = gradients()
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        move = first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        both = both - rate * move
        both[:-1] -= rate * reg * both[:-1]


def fit(train: DataFrame, val: DataFrame | None = None, tokens: str = "tokens", label: str = "label",
        bits: int = FEATURE_BITS, reg: float = REG, iterations: int = ITERATIONS, rate: float = RATE,
        factor: float = 1.2) -> LinearScorer:
    """Train for `iterations` rounds; of all rounds that with the best F1 on `val`, then the lowest loss, stays.

    Positives weigh (negatives / positives) x `factor`. Rows without a label are left out; null tokens are none.
    Without `val` the last round stays; without rows, or with one class only, training still ends. Tokens are
    hashed once into blocks, which are written, and once more with the rows' lengths when frequencies are known;
    every round reads these, in one task per core. `train` and `val` should be cheap to read.
    """
    columns = [F.col(label).cast("int").alias("label"), hashed_features(tokens, bits).alias("features")]
    sides = [train.select(F.lit(True).alias("is_train"), *columns)]
    if val is not None:
        sides.append(val.select(F.lit(False).alias("is_train"), *columns))
    hashed = (sides[0] if val is None else sides[0].unionByName(sides[1])).where("label is not null")
    packed = settle(packed_rows(hashed), "features")
    inverse, told = inverse_frequencies(packed, bits)
    table = settle(weighed(packed, inverse), "weighed")
    sizes = tuple(sum(n for (side, _), n in told.items() if side == which) for which in (True, False))
    positives = told.get((True, True), 0)
    positive = (sizes[0] - positives) / positives * factor if positives else 1.0
    # Each task hands over a gradient: as few tasks as keep all cores busy.
    rows = table.coalesce(table.sparkSession.sparkContext.defaultParallelism)

    scorer = LinearScorer(bits, inverse, np.zeros(2 << bits), 0.0)
    latest: list = [None]
    best, epochs = None, []
    for number, (weights, bias) in enumerate(steps(lambda: latest[0], 2 << bits, rate, reg)):
        scorer = replace(scorer, weights=weights, bias=bias)
        gradient, told_now = _round(rows, scorer, positive, sizes)
        latest[0] = np.append(gradient, told_now[BIAS] / UNIT)
        if number:
            epochs.append(_epoch(number, told_now))
            rank = (epochs[-1]["f1"], -epochs[-1]["loss"]) if val is not None else (number, 0)
            if best is None or rank > best[0]:
                best = rank, number, scorer
        if number == iterations:
            break
    if best is None:
        return scorer
    epochs[best[1] - 1]["is_best"] = True
    return replace(best[2], epochs=tuple(epochs))


def margins(scorer: LinearScorer, features: Column, alone: bool = False) -> Column:
    """Log-odds of each row from its feature numbers; `alone`: without bias and without scaling rows to length one."""
    shared = SparkContext.getOrCreate().broadcast((scorer.inverse, scorer.weights, scorer.bias))

    def score(lists: pa.Array) -> pa.Array:
        inverse, weights, bias = shared.value
        out = np.zeros(len(lists))
        for at, some in _runs(lists):
            if alone:
                ids = some.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(some)), pc.list_value_length(some).to_numpy(zero_copy_only=False))
                value = inverse[ids]
            else:
                ids, row, n = _counted(some)
                ids, row, n = (x[inverse[ids] > 0] for x in (ids, row, n))
                value = n * inverse[ids] / _lengths(row, ids, n, inverse, len(some))[row]
            out[at:at + len(some)] = np.bincount(row, value * weights[ids], len(some)) + (0 if alone else bias)
        return pa.array(out)

    return F.arrow_udf(score, "double")(features)
