"""Quality classifier: hashed subword vectors, averaged per document, softmax on top.

Features of a text are its words, their character n-grams, and pairs of neighbouring words, all
hashed into one table (a word said twice in a row is one feature, whatever the word). Vectors and output layer
are learned by stochastic gradient descent in numpy on a bounded sample of labelled rows. As the
output layer is linear before the softmax, the learned vectors are then folded into one number per
feature and class; scoring adds those up per distinct word and averages them per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import chunks

BITS = 18
GRAMS = (3, 4)
DIM = 16
EPOCHS = 6
RATE = 0.5
SAMPLE = 5_000
SEED = 20_240_501
KEEP = 0.3

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MULTIPLY
    return ((h ^ (h >> np.uint64(32))) * _MULTIPLY) >> np.uint64(64 - BITS)


@dataclass
class Pieces:
    """Distinct words of some texts with their features, and the texts as word numbers."""

    index: np.ndarray  # word number of every word of every text
    starts: np.ndarray  # where the words of a text start, one more at the end
    codes: np.ndarray  # 64-bit code of each distinct word
    features: np.ndarray  # features of the distinct words in a row
    owner: np.ndarray  # the distinct word of each feature

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature of each word with its predecessor, and whether there is one in the same text."""
        now = self.codes[self.index]
        before = np.concatenate([now[:1], now[:-1]])
        pair = _mix(np.where(before == now, np.uint64(1), before * _STEP + now))
        inner = np.ones(len(now), bool)
        first = self.starts[:-1]
        inner[first[first < len(now)]] = False
        return pair, inner


def pieces_of(texts: pa.Array) -> Pieces:
    flat, starts = chunks.cut(texts)
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8) if len(words) \
        else np.zeros(1, np.int64)
    data = words.buffers()[2] if len(words) else None
    letters = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    base = int(offsets[0])
    letters, offsets = letters[base:int(offsets[-1])].astype(np.uint64) + np.uint64(1), offsets - base
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = offsets[1:][owner] - np.arange(len(letters))  # letters of the word from here on
    with np.errstate(over="ignore"):
        place = np.arange(len(letters)) - offsets[:-1][owner]
        powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, _STEP, np.uint64))
        codes = np.zeros(len(sizes), np.uint64)
        filled = np.flatnonzero(sizes)
        if len(filled):
            codes[filled] = np.add.reduceat(letters * powers[place], offsets[:-1][filled])
        features, owners = [_mix(codes)], [np.arange(len(sizes))]
        rolled = letters.copy()
        for n in range(2, max(GRAMS) + 1):
            rolled = rolled[:-1] * _STEP + letters[n - 1:] if len(rolled) else rolled
            if n in GRAMS:
                inside = np.flatnonzero(left[: len(rolled)] >= n)
                features.append(_mix(rolled[inside] + np.uint64(n)))
                owners.append(owner[inside])
    index = coded.indices.to_numpy().astype(np.int64)
    return Pieces(index, starts, codes, np.concatenate(features).astype(np.int64), np.concatenate(owners))


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text and their share of all its features."""
    with np.errstate(over="ignore"):
        p = pieces_of(texts)
        pair, inner = p.pairs()
    order = np.argsort(p.owner, kind="stable")
    grouped = p.features[order]
    edges = np.searchsorted(p.owner[order], np.arange(len(p.codes) + 1))
    for a, b in zip(p.starts[:-1], p.starts[1:], strict=True):
        word, n = np.unique(p.index[a:b], return_counts=True)
        width = edges[word + 1] - edges[word]
        at = np.repeat(edges[word] - np.cumsum(width) + width, width) + np.arange(width.sum())
        both = np.concatenate([grouped[at], pair[a:b][inner[a:b]].astype(np.int64)])
        weight = np.concatenate([np.repeat(n, width), np.ones(len(both) - len(at))])
        found, where = np.unique(both, return_inverse=True)
        total = np.bincount(where, weight, len(found))
        yield found.astype(np.int32), (total / max(1.0, total.sum())).astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent over (class, features, shares); gives scores per feature and bias."""
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    output, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    steps = EPOCHS * max(1, len(rows))
    step = 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            label, found, share = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mine = vectors[found]
            hidden = share @ mine
            scores = hidden @ output + bias
            odds = np.exp(scores - scores.max())
            error = odds / odds.sum()
            error[label] -= 1
            # Shares are small; a feature's step is scaled up so that vectors learn as fast as the output.
            back = output @ error
            output -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            vectors[found] = mine - (rate * np.minimum(share * 20, 1))[:, None] * back
    return vectors @ output, bias


def held_out(key: str) -> Column:
    """crc32 of the key as text leaves no remainder by 5; null keys are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
        sample: int = SAMPLE) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Learn from at most `sample` labelled rows that are not held out (those with the smallest hash).

    Rows without key or label are left out, rows with two labels count with both. Returns the label
    values, scores per feature and class, and biases; without any labelled row a model that
    scores 0.5 for labels 0 and 1. One task trains on the sample; the driver gets only the model.
    """
    order = F.xxhash64(F.col("key"), F.lit(SEED))
    known = labels.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("int").alias("label"))
    known = (known.where(F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out("key"))
             .orderBy(order, "key", "label").limit(sample))  # bounded, so it may be broadcast
    rows = (docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
            .join(F.broadcast(known), "key").select(order.alias("order"), "key", "label", "text"))

    def features(batches):
        for batch in batches:
            for at, part in chunks.slices(batch.column(3), chunks.WORK_BYTES):
                found = list(bags(part))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(part)) for i in range(3)),
                     pa.array([f.tobytes() for f, _ in found], pa.binary()),
                     pa.array([s.tobytes() for _, s in found], pa.binary())],
                    names=["order", "key", "label", "features", "shares"])

    def learn(batches):
        read: list[tuple[int, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(read) < sample:  # only repeated keys give more rows
                    read.append((row["label"], np.frombuffer(row["features"], np.int32),
                                 np.frombuffer(row["shares"], np.float32)))
        values = sorted({label for label, _, _ in read} | {0, 1})
        place = {v: i for i, v in enumerate(values)}
        table, bias = train([(place[label], f, s) for label, f, s in read], len(values))
        yield pa.RecordBatch.from_arrays(
            [pa.array([values], pa.list_(pa.int32())), pa.array([table.astype("<f4").tobytes()], pa.binary()),
             pa.array([bias.astype("<f4").tobytes()], pa.binary())], names=["labels", "scores", "bias"])

    bagged = rows.mapInArrow(chunks.tidied(features), "order bigint, key bigint, label int, features binary, shares binary")
    model = (bagged.repartition(1).sortWithinPartitions("order", "key", "label", "features")
             .mapInArrow(chunks.tidied(learn), "labels array<int>, scores binary, bias binary")).first()
    if model is None:
        return [0, 1], np.zeros((1 << BITS, 2), np.float32), np.zeros(2, np.float32)
    values = list(model["labels"])
    return (values, np.frombuffer(model["scores"], "<f4").reshape(-1, len(values)),
            np.frombuffer(model["bias"], "<f4"))


def probabilities(texts: pa.Array, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Probability of each class for each text; a text without words is judged by the bias."""
    with np.errstate(over="ignore"):
        p = pieces_of(texts)
        pair, inner = p.pairs()
    classes = len(bias)
    per_word = np.bincount(p.owner, minlength=len(p.codes)).astype(np.float64)
    ends = np.concatenate([[0.0], np.cumsum(per_word[p.index] + inner)])
    total = np.maximum(ends[p.starts[1:]] - ends[p.starts[:-1]], 1)
    scores = np.empty((len(total), classes))
    for c in range(classes):
        column = np.ascontiguousarray(table[:, c]).astype(np.float64)
        of_word = np.bincount(p.owner, column[p.features], len(p.codes))
        of_place = of_word[p.index] + np.where(inner, column[pair.astype(np.int64)], 0)
        ends = np.concatenate([[0.0], np.cumsum(of_place)])
        scores[:, c] = (ends[p.starts[1:]] - ends[p.starts[:-1]]) / total + bias[c]
    odds = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    return odds / odds.sum(axis=1, keepdims=True)


def score(docs: DataFrame, model: tuple[list[int], np.ndarray, np.ndarray], key: str = "doc_id",
          text: str = "text", good: int = 1, keep: float = KEEP, columns: tuple[str, ...] = ()) -> DataFrame:
    """(columns, key, held_out, score, predicted) per row: `score` is the probability of label `good`.

    Whole texts are read; null text is empty; null keys and repeated rows stay; an empty table gives no
    rows. `columns` names columns of `docs` to pass through. The model is a few MB by its parameters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        values, table, bias = shared.value
        column = values.index(good)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at, part in chunks.slices(texts, chunks.WORK_BYTES):
                odds = probabilities(part, table, bias)[:, column]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(part)) for i in range(batch.num_columns - 1)),
                     pa.array(np.clip(odds, 0.0, 1.0), pa.float64())],
                    names=[*batch.schema.names[:-1], "_score"])

    passed = [F.col(c) for c in columns]
    rows = docs.select(*passed, F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    judged = rows.mapInArrow(chunks.tidied(judge), f"{kinds}, _score double")
    return judged.select(*passed, F.col("_key").alias(key) if key not in columns else F.col("_key"),
                         held_out("_key").alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= keep).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, whose score reaches `keep`."""
    marked = docs.withColumnsRenamed({c: f"in_{i}" for i, c in enumerate(docs.columns)})
    name = dict(zip(docs.columns, marked.columns, strict=True))
    judged = score(marked, fit(docs, labels, key=key, text=text), name[key], name[text],
                   keep=keep, columns=tuple(marked.columns))
    return judged.where("predicted = 1").select(*(F.col(name[c]).alias(c) for c in docs.columns))
