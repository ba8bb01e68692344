"""Scorers: train, score in batches, calibrate, evaluate, explain."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring
from ..session import settle
from . import evaluate, trainer
from .curate import token_frequency
from .detect import ranked_tokens
from .skew import salted_join

# Words sent to every task: so many at most, of so many bytes each.
COMMON_TOKENS, COMMON_BYTES = 2**17, 64
BLOCK_TOKENS = 2**20


def with_class_weight(df: DataFrame, label: str = "label", factor: float = 1.2) -> DataFrame:
    """Weight positives by safe/vulnerable times `factor`, negatives by 1."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("p"),
                    F.count_if(F.col(label) != 1).alias("q"))
    positive = F.coalesce(F.try_divide("q", "p") * factor, F.lit(1.0))
    # Two rows, one per label.
    weights = counts.select(F.inline(F.array(
        F.struct(F.lit(1).alias(label), positive.alias("weight")),
        F.struct(F.lit(0).alias(label), F.lit(1.0).alias("weight")))))
    return df.join(F.broadcast(weights), label)


def train_classifier(train: DataFrame, val: DataFrame | None = None, label: str = "label", **options
                     ) -> trainer.LinearScorer:
    """Hashed token and bigram weights with a weighted logistic loss; `val` chooses the round that stays."""
    return trainer.fit(train, val, label=label, **options)


def score_batch(scorer: trainer.LinearScorer, df: DataFrame, out: str = "prob", tokens: str = "tokens") -> DataFrame:
    return df.withColumn(out, scoring.sigmoid(trainer.margins(scorer, trainer.hashed_features(tokens, scorer.bits))))


def score_with(function: Callable[[pd.Series], pd.Series], df: DataFrame, column: str,
               out: str = "prob") -> DataFrame:
    """Score with a user's vectorised function over Arrow batches."""
    return df.withColumn(out, F.pandas_udf(function, "double")(F.col(column)))


def calibrate(scored: DataFrame, thresholds: Sequence[float] = evaluate.THRESHOLDS
              ) -> DataFrame:
    return evaluate.best_threshold(evaluate.threshold_sweep(scored, thresholds))


def evaluate_scores(scored: DataFrame, threshold: Column | float) -> DataFrame:
    """Confusion counts, ratios and ROC area in one row."""
    metrics = evaluate.with_metrics(evaluate.confusion(scored, threshold))
    area = evaluate.roc_auc(scored).select("auc")
    both = metrics.unionByName(area, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def token_table(scorer: trainer.LinearScorer, df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, n, weight): what each token of a corpus adds to the scorer's log-odds, before rows are scaled.

    Every distinct token is scored as a text of its own.
    """
    each = token_frequency(df, tokens).withColumn("_alone", F.array("token"))
    weight = trainer.margins(scorer, trainer.hashed_features("_alone", scorer.bits), alone=True)
    return each.select("token", "n", weight.alias("weight"))


def explain_topk(scorer: trainer.LinearScorer, df: DataFrame, key: str, tokens: str = "tokens",
                 limit: int = 5) -> DataFrame:
    """The tokens of each row that speak most for `vulnerable`."""
    weighted = token_weights(df, token_table(scorer, df, tokens), key, tokens, "n")
    return weighted.select(key, ranked_tokens(F.col("token_weights"), limit).alias("tokens"))


def token_weights(df: DataFrame, weights: DataFrame, key: str, tokens: str = "tokens",
                  count: str | None = None) -> DataFrame:
    """Contribution of each token of a row: `weights` holds (token, weight) and, if
    `count` names it, how often the token occurs.

    Gives `array<struct<token,weight,pos>>` for `detect.ranked_tokens`; rows with one key are taken together.
    Rows stay whole: each is dealt to its key once and its tokens are counted in Arrow batches. The weights of the
    commonest tokens (`COMMON_TOKENS` at most) are sent to the tasks once. Only the other tokens are joined
    one by one, with hot tokens salted, and follow their rows. The weights are written down first.
    """
    kept = F.col("weight").cast("double").alias("weight")
    weights = settle(weights.select("token", kept, *[count] if count else []), "weights")
    common = _common(weights, count)
    local = weights.where(common).select("token", F.coalesce("weight", F.lit(0.0)).alias("weight")).toArrow()
    rare = (df.select(key, F.explode(tokens).alias("token")).where("token IS NOT NULL")
            .join(F.broadcast(weights.where(common).select("token")), "token", "left_anti"))
    found = salted_join(rare, weights.where(~common), ["token"], "inner", [key], count).select(
        F.col(key).alias("_key"), F.array("token").alias("tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    rows = df.select(F.col(key).alias("_key"), F.col(tokens).alias("tokens"), F.lit(None).cast("double").alias("weight"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("token_weights", T.ArrayType(
        T.StructType().add("token", "string").add("weight", "double").add("pos", "integer")))])
    return rows.union(found).repartition("_key").sortWithinPartitions("_key").mapInArrow(
        _weigh(local, df.sparkSession, key), schema)


def _common(weights: DataFrame, count: str | None) -> Column:
    """Whether a token is one of the most frequent; counts are compared by steps of a quarter of a power of two."""
    if count is None:
        return F.lit(False)
    step = F.floor(F.log2(count) * 4)
    short = F.octet_length("token") <= COMMON_BYTES
    # At most 4 * 64 rows.
    steps = weights.where(short).groupBy(step.alias("step")).agg(F.count("*").alias("n")).where("step IS NOT NULL").collect()
    total, least = 0, None
    for row in sorted(steps, reverse=True):
        total += row["n"]
        if total > COMMON_TOKENS:
            break
        least = row["step"]
    return F.lit(False) if least is None else F.coalesce(short & (step >= least), F.lit(False))


def _weigh(common: pa.Table, spark: SparkSession, key: str):
    """(_key, tokens, weight) sorted by key to (key, token_weights). A row with a weight tells it of its only token.

    Some `BLOCK_TOKENS` tokens are counted at once; of the last key, which may go on, the counts are held back.
    """
    shared = spark.sparkContext.broadcast((common["token"].combine_chunks(), common["weight"].to_numpy()))
    columns = ["group", "token", "times", "pos", "weight"]

    def count(rows: pa.RecordBatch, sizes: np.ndarray, group: np.ndarray, held: pa.Table | None) -> pa.Table:
        told = rows["weight"]
        times = np.repeat(told.is_null().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        spots = pa.table([np.repeat(group, sizes), rows["tokens"].flatten(), times, pa.array(pos, mask=times == 0),
                          told.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))], columns)
        spots = pa.concat_tables([held, spots]) if held is not None else spots
        spots = spots.group_by(["group", "token"], use_threads=False).aggregate(
            [("times", "sum"), ("pos", "min"), ("weight", "max")]).select(
            ["group", "token", "times_sum", "pos_min", "weight_max"]).rename_columns(columns)
        return spots.sort_by("group") if np.any(np.diff(spots["group"].to_numpy()) < 0) else spots

    def weighed(keys: pa.Array, spots: pa.Table) -> pa.RecordBatch:
        """`keys` has the key of each group."""
        words, weights = shared.value
        place = pc.index_in(spots["token"], words).combine_chunks()
        # One place past the end stands for other words.
        own = np.append(weights, 0.0)[pc.fill_null(place, len(words)).to_numpy()]
        weight = np.where(place.is_valid().to_numpy(zero_copy_only=False), own,
                          pc.fill_null(spots["weight"], 0.0).to_numpy())
        group = spots["group"].to_numpy()
        firsts = np.flatnonzero(np.diff(group, prepend=-1))
        entries = pa.StructArray.from_arrays(
            [spots["token"].combine_chunks(), pa.array(weight * spots["times"].to_numpy()),
             spots["pos"].combine_chunks().cast(pa.int32())], ["token", "weight", "pos"])
        ends = pa.array(np.append(firsts, len(group)), pa.int32())
        return pa.RecordBatch.from_arrays([keys.take(pa.array(group[firsts])), pa.ListArray.from_arrays(ends, entries)],
                                          [key, "token_weights"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            every = pc.fill_null(pc.list_value_length(batch["tokens"]), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(every, dtype=np.int64) // BLOCK_TOKENS)) + 1
            for start, stop in pairwise([0, *cuts, len(every)]):
                rows = batch.slice(start, stop - start)
                keys = rows["_key"] if last is None else pa.concat_arrays([last, rows["_key"]])
                if not len(keys):
                    continue
                codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
                group = np.cumsum(np.diff(codes, prepend=codes[0]) != 0)
                spots = count(rows, every[start:stop], group[len(group) - len(rows):], held)
                cut = int(np.searchsorted(spots["group"].to_numpy(), group[-1]))
                if cut:
                    yield weighed(keys.take(pa.array(np.flatnonzero(np.diff(group, prepend=-1)))), spots.slice(0, cut))
                last, held = keys.slice(len(keys) - 1), spots.slice(cut)
                held = held.set_column(0, "group", pa.array(np.zeros(len(held), np.int64)))
        if held is not None and len(held):
            yield weighed(last, held)

    return weigh
