"""Classifier evaluation: confusion counts, ratios, ROC area, threshold search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring

# The twenty thresholds tried, 0.30 up to 0.68.
THRESHOLDS = tuple(0.30 + i * 0.02 for i in range(20))


def confusion(df: DataFrame, threshold: Column | float, keys: Sequence[str] = (),
              prob: str = "prob", label: str = "label") -> DataFrame:
    said, true = F.col(prob) >= threshold, F.col(label) == 1
    return df.groupBy(*keys).agg(
        F.count_if(said & true).alias("tp"), F.count_if(~said & ~true).alias("tn"),
        F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))


def with_metrics(counts: DataFrame, digits: int | None = 6) -> DataFrame:
    """Ratios of `tp, tn, fp, fn`; a ratio without a denominator is 0."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn

    def ratio(a: Column, b: Column) -> Column:
        value = F.coalesce(F.try_divide(a, b), F.lit(0.0))
        return value if digits is None else F.bround(value, digits)

    chance = (tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)
    return counts.withColumns({
        "accuracy": ratio(tp + tn, n),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(tp * 2, tp * 2 + fp + fn),
        "fpr": ratio(fp, fp + tn),
        "mcc": ratio(tp * tn - fp * fn,
                     F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
        "kappa": ratio(n * (tp + tn) - chance, n * n - chance),
    })


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS,
                    prob: str = "prob", label: str = "label") -> DataFrame:
    """Confusion counts and ratios at every threshold, in one pass over the scores.

    Each score is put into the band between two thresholds; the few band counts are then
    summed from the top. Scores are not repeated per threshold.
    """
    band = reduce(lambda a, b: a + b, [(F.col(prob) >= t).cast("int") for t in thresholds])
    bands = df.groupBy(band.alias("band")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q"))
    grid = F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(float(t)).alias("threshold"))
                     for i, t in enumerate(thresholds)])
    at_least = F.col("band") >= F.col("_i")
    # At most one row per band meets the thresholds here, whatever the size of the input.
    counts = bands.select("*", F.inline(grid)).groupBy("threshold").agg(
        F.coalesce(F.sum(F.when(at_least, F.col("_p"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~at_least, F.col("_q"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(at_least, F.col("_q"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~at_least, F.col("_p"))), F.lit(0)).alias("fn"))
    return with_metrics(counts)


def best_threshold(sweep: DataFrame, default: float = 0.5) -> DataFrame:
    """First threshold with the greatest F1; the default when every F1 is 0."""
    best = sweep.agg(F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold")))
                     .alias("threshold"), F.max("f1").alias("f1"))
    return best.select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(default)
                       .alias("threshold"), "f1")


def roc_auc(df: DataFrame, prob: str = "prob", label: str = "label", levels: int = 3,
            bits: int = 12) -> DataFrame:
    """Exact rank-based area under the ROC curve, ties counted half.

    Counts (positive, negative) pairs in the right order. Equal scores are merged first.
    A score in [0, 1] is read digit by digit (`bits` binary digits at a time); two scores
    are compared at the first digit in which they differ, so each running sum covers one
    digit's values only and no task sees the whole order.
    """
    base = 2 ** bits
    points = df.groupBy(F.col(prob).alias("p")).agg(
        F.count_if(F.col(label) == 1).cast("decimal(19,0)").alias("pos"),
        F.count_if(F.col(label) != 1).cast("decimal(19,0)").alias("neg"))
    rest, digits = F.col("p"), []
    for i in range(levels):
        points = points.withColumn(f"d{i}", F.floor(rest * base))
        rest = rest * base - F.col(f"d{i}")
        digits.append(f"d{i}")

    def below(parent: list[str], by: str) -> Column:
        window = (Window.partitionBy(*(parent or [F.lit(0)])).orderBy(by)
                  .rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(F.sum("neg").over(window), F.lit(0)).cast("decimal(19,0)")

    pieces, table = [], points
    steps = [(digits[:i], d) for i, d in enumerate(digits)] + [(digits, "p")]
    for parent, by in reversed(steps):
        table = table.groupBy(*parent, by).agg(F.sum("pos").cast("decimal(19,0)").alias("pos"),
                                               F.sum("neg").cast("decimal(19,0)").alias("neg"))
        # Products of counts can pass 2^63, hence decimals.
        lower = (F.col("pos") * below(parent, by)).cast("decimal(38,0)")
        same = (F.col("pos") * F.col("neg")).cast("decimal(38,0)") if by == "p" else F.lit(0)
        pieces.append(table.select((lower + lower + same).cast("decimal(38,0)").alias("_twice")))
    totals = points.agg(F.sum("pos").cast("bigint").alias("n_pos"),
                        F.sum("neg").cast("bigint").alias("n_neg"))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [totals, *pieces])
    summed = both.agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
                      F.sum("_twice").cast("double").alias("_u"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg") * 2
    return summed.select("n_pos", "n_neg",
                         F.bround(F.try_divide(F.col("_u"), pairs), 6).alias("auc"))


def weighted_log_loss(df: DataFrame, positive_weight: Column | float, prob: str = "prob",
                      label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(scoring.log_loss(
        F.col(prob), F.col(label), positive_weight)).alias("loss"))


def best_checkpoint(epochs: DataFrame) -> DataFrame:
    """Epoch with the greatest F1, then the lowest loss, then the earliest."""
    rank = F.struct(F.col("f1"), -F.col("loss"), -F.col("epoch"))
    return epochs.agg(F.max_by(F.struct("epoch", "f1", "loss"), rank).alias("b")).select("b.*")


METRICS = ("accuracy", "precision", "recall", "f1", "fpr")


def model_delta(metrics: DataFrame, left: str, right: str, model: str = "model",
                names: Sequence[str] = METRICS) -> DataFrame:
    """Metric differences of two models, in percentage points."""
    long = metrics.unpivot([model], list(names), "metric", "value")
    return long.groupBy("metric").agg(
        F.max(F.when(F.col(model) == left, F.col("value"))).alias("left_value"),
        F.max(F.when(F.col(model) == right, F.col("value"))).alias("right_value"),
    ).withColumn("delta_points",
                 F.bround((F.col("left_value") - F.col("right_value")) * 100, 2))
