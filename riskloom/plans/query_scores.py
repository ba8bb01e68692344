"""Registered queries: classifier evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import curate, evaluate
from . import jobs
from . import tables as t
from .query_corpus import _parity
from .registry import query


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE round_even(({a}) / ({b}), 6) END"


def metrics_sql(keys: str, source: str) -> str:
    """Ratios over rows with tp, tn, fp, fn."""
    chance = "((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp))"
    n = "(tp + tn + fp + fn)"
    ratios = {
        "accuracy": _ratio("tp + tn", n), "precision": _ratio("tp", "(tp + fp)"),
        "recall": _ratio("tp", "(tp + fn)"), "f1": _ratio("2 * tp", "(2 * tp + fp + fn)"),
        "fpr": _ratio("fp", "(fp + tn)"),
        "mcc": _ratio("tp * tn - fp * fn",
                      "(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn))"),
        "kappa": _ratio(f"{n} * (tp + tn) - {chance}", f"({n} * {n} - {chance})"),
    }
    return (f"SELECT {keys}tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, "
            + ", ".join(f"{v} AS {k}" for k, v in ratios.items())
            + f" FROM (SELECT {keys}tp::DOUBLE AS tp, tn::DOUBLE AS tn, fp::DOUBLE AS fp, "
              f"fn::DOUBLE AS fn FROM {source})")


def counts_sql(cut: str, source: str = "scores", keys: str = "", group: str = "") -> str:
    return (f"SELECT {keys}count(*) FILTER (prob >= {cut} AND label = 1) AS tp, count(*) FILTER "
            f"(prob < {cut} AND label = 0) AS tn, count(*) FILTER (prob >= {cut} AND label = 0) AS "
            f"fp, count(*) FILTER (prob < {cut} AND label = 1) AS fn FROM {source}{group}")


@query("confusion_matrix", t.with_ctes(("scores",), counts_sql("0.5")))
def confusion_matrix(spark, base):
    return evaluate.confusion(t.scores(spark, base), 0.5)


@query("classification_metrics", t.with_ctes(
    ("scores",), metrics_sql("", "c"), c=counts_sql("0.5")))
def classification_metrics(spark, base):
    return evaluate.with_metrics(evaluate.confusion(t.scores(spark, base), 0.5))


SWEEP = {"grid": "SELECT 0.30::DOUBLE + i * 0.02::DOUBLE AS threshold FROM range(20) AS g(i)",
         "c": counts_sql("threshold", "scores, grid", "threshold, ", " GROUP BY threshold")}


@query("threshold_sweep", t.with_ctes(
    ("scores",), "SELECT * REPLACE (round_even(threshold, 2) AS threshold) FROM ("
    + metrics_sql("threshold, ", "c") + ")", **SWEEP))
def threshold_sweep(spark, base):
    return evaluate.threshold_sweep(t.scores(spark, base)).withColumn(
        "threshold", F.bround("threshold", 2))


@query("best_threshold", t.with_ctes(("scores",), (
    "SELECT round_even(threshold, 2) AS threshold, f1 FROM m ORDER BY f1 DESC, threshold LIMIT 1"),
    **SWEEP, m=metrics_sql("threshold, ", "c")))
def best_threshold(spark, base):
    sweep = evaluate.threshold_sweep(t.scores(spark, base))
    return evaluate.best_threshold(sweep).withColumn("threshold", F.bround("threshold", 2))


@query("roc_auc", t.with_ctes(("scores",), (
    "SELECT p AS n_pos, q AS n_neg, round_even((s - p * (p + 1) / 2.0::DOUBLE) / (p * q), 6) AS "
    "auc FROM (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q, sum(r) "
    "FILTER (label = 1) AS s FROM ranked)"),
    ranked="SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / "
           "2.0::DOUBLE AS r FROM scores"))
def roc_auc(spark, base):
    return evaluate.roc_auc(t.scores(spark, base))


LOSS = ("-(1.2::DOUBLE * label * ln(least(greatest(prob, 1e-7), 1 - 1e-7)) + (1 - label) * "
        "ln(1 - least(greatest(prob, 1e-7), 1 - 1e-7)))")


@query("weighted_log_loss", t.with_ctes(
    ("scores",), f"SELECT label, round_even(avg({LOSS}), 6) AS loss FROM scores GROUP BY 1"))
def weighted_log_loss(spark, base):
    return evaluate.weighted_log_loss(t.scores(spark, base), 1.2, keys=["label"]).withColumn(
        "loss", F.bround("loss", 6))


def _epochs(spark, base):
    """Each vector component is taken as one epoch's logit."""
    logits = F.posexplode("embedding").alias("epoch", "logit")
    rows = t.load(spark, base, "embeddings").select(
        (F.col("label") >= 5).cast("int").alias("label"), logits)
    return rows.select("epoch", "label", F.bround(scoring.sigmoid(
        F.col("logit").cast("double") * 8), 6).alias("prob"))


EPOCH_SQL = {
    "rows_": "SELECT generate_subscripts(embedding, 1) - 1 AS epoch, round_even("
             "1::DOUBLE / (1::DOUBLE + exp(-(unnest(embedding)::DOUBLE * 8))), 6) AS "
             "prob, CAST(label >= 5 AS INT) AS label FROM embeddings",
    "c": counts_sql("0.5", "rows_", "epoch, ", " GROUP BY epoch"),
    "losses": f"SELECT epoch, round_even(avg({LOSS}), 6) AS loss FROM rows_ GROUP BY 1"}


@query("best_checkpoint", t.with_ctes((), (
    "SELECT m.epoch::INT AS epoch, f1, loss FROM m JOIN losses l ON l.epoch = m.epoch ORDER BY f1 "
    "DESC, loss, m.epoch LIMIT 1"), **EPOCH_SQL, m=metrics_sql("epoch, ", "c")))
def best_checkpoint(spark, base):
    rows = _epochs(spark, base)
    f1 = evaluate.with_metrics(evaluate.confusion(rows, 0.5, ["epoch"])).select("epoch", "f1")
    loss = evaluate.weighted_log_loss(rows, 1.2, keys=["epoch"]).withColumn(
        "loss", F.bround("loss", 6))
    return evaluate.best_checkpoint(f1.join(loss, "epoch"))


@query("model_delta", t.with_ctes((), (
    "SELECT metric, a AS left_value, b AS right_value, round_even((a - b) * 100, 2) AS "
    "delta_points FROM (SELECT metric, max(value) FILTER (model = 'first') AS a, max(value) FILTER "
    "(model = 'second') AS b FROM long GROUP BY 1)"),
    first_=t.scores_cte(1), second_=t.scores_cte(2),
    c="SELECT 'first' AS model, * FROM (" + counts_sql("0.5", "first_") + ") UNION ALL SELECT "
      "'second', * FROM (" + counts_sql("0.5", "second_") + ")",
    m=metrics_sql("model, ", "c"),
    long="SELECT model, metric, value FROM m UNPIVOT (value FOR metric IN (accuracy, precision, "
         "recall, f1, fpr))"))
def model_delta(spark, base):
    """Two detectors: two weightings of the vector."""
    both = t.scores(spark, base, 1).withColumn("model", F.lit("first")).unionByName(
        t.scores(spark, base, 2).withColumn("model", F.lit("second")))
    metrics = evaluate.with_metrics(evaluate.confusion(both, 0.5, ["model"]))
    return evaluate.model_delta(metrics, "first", "second")


@query("train_and_evaluate")
def train_and_evaluate(spark, base):
    """Train on the curated documents and measure on the test split (no SQL form)."""
    rows = curate.normalise(curate.resolve_copies(_parity(spark, base)), language=F.lit("py"))
    curated = jobs.settle(rows.select("ord", "label", "tokens"), "curated")
    return jobs.train_and_evaluate(curate.stratified_split(curated, "ord"))[1]
