"""Metrics against published counts and brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import detect, evaluate, model, trainer
from riskloom.plans import jobs
from riskloom.sources import corpus

GOLDEN = {  # tp, tn, fp, fn -> accuracy, precision, recall, f1, fpr
    (77, 94, 6, 13): (0.9, 0.927711, 0.855556, 0.890173, 0.06),
    (73, 91, 9, 17): (0.863158, 0.890244, 0.811111, 0.848837, 0.09),
    (68, 87, 13, 22): (0.815789, 0.839506, 0.755556, 0.795322, 0.13),
    (26, 97, 3, 64): (0.647368, 0.896552, 0.288889, 0.436975, 0.03)}


def test_metrics_from_counts(spark):
    df = spark.createDataFrame(list(GOLDEN), "tp long, tn long, fp long, fn long")
    for r in evaluate.with_metrics(df).collect():
        want = GOLDEN[(r["tp"], r["tn"], r["fp"], r["fn"])]
        assert (r["accuracy"], r["precision"], r["recall"], r["f1"], r["fpr"]) == want
        if r["tp"] == 26:
            assert (r["mcc"], r["kappa"]) == (0.359437, 0.26797)


def test_empty_ratios_are_zero(spark):
    df = spark.createDataFrame([(0, 5, 0, 0)], "tp long, tn long, fp long, fn long")
    r = evaluate.with_metrics(df).first()
    assert (r["precision"], r["recall"], r["f1"], r["mcc"], r["kappa"]) == (0, 0, 0, 0, 0)


def scored(spark, rng, n, values):
    rows = [(rng.choice(values), int(rng.random() < 0.4)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "prob double, label int")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auc_matches_pair_count(spark, seed):
    rng = random.Random(seed)
    values = [0.0, 1.0, 0.5, 0.5 + 2 ** -40, 0.5 + 2 ** -52, 1e-300, 1e-9] + [
        rng.random() for _ in range(40)]
    rows, df = scored(spark, rng, 300, values)
    pos, neg = [p for p, l in rows if l], [p for p, l in rows if not l]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    got = evaluate.roc_auc(df, bits=4).first()
    assert (got["n_pos"], got["n_neg"]) == (len(pos), len(neg))
    assert abs(got["auc"] - want) < 1e-6
    assert evaluate.roc_auc(df).first()["auc"] == got["auc"]


def test_sweep_matches_brute_force(spark):
    rng = random.Random(9)
    grid = [round(0.25 + i * 0.01, 2) for i in range(50)]
    rows, df = scored(spark, rng, 400, grid + list(evaluate.THRESHOLDS))
    sweep = evaluate.threshold_sweep(df)
    got = {r["threshold"]: (r["tp"], r["tn"], r["fp"], r["fn"]) for r in sweep.collect()}
    assert len(got) == 20
    for t in evaluate.THRESHOLDS:
        assert got[t] == (sum(p >= t and l == 1 for p, l in rows),
                          sum(p < t and l == 0 for p, l in rows),
                          sum(p >= t and l == 0 for p, l in rows),
                          sum(p < t and l == 1 for p, l in rows))
    f1 = {r["threshold"]: r["f1"] for r in sweep.collect()}
    best = evaluate.best_threshold(sweep).first()
    assert best["f1"] == max(f1.values())
    assert best["threshold"] == min(t for t, v in f1.items() if v == best["f1"])


def test_best_threshold_default(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 0)], "prob double, label int")
    assert evaluate.best_threshold(evaluate.threshold_sweep(df)).first()["threshold"] == 0.5


def test_log_loss_and_checkpoint(spark):
    df = spark.createDataFrame([(0.8, 1), (0.4, 0), (0.0, 1)], "prob double, label int")
    want = (-2 * math.log(0.8) - math.log(0.6) - 2 * math.log(1e-7)) / 3
    assert abs(evaluate.weighted_log_loss(df, 2.0).first()["loss"] - want) < 1e-9
    epochs = spark.createDataFrame([(1, 0.5, 0.3), (2, 0.7, 0.4), (3, 0.7, 0.2), (4, 0.7, 0.2)],
                                   "epoch int, f1 double, loss double")
    assert evaluate.best_checkpoint(epochs).first()["epoch"] == 3


def test_training_learns_a_marker_token(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        label = int(rng.random() < 0.3)
        tokens = [rng.choice(["a", "b", "c", "d"]) for _ in range(10)]
        if label:
            tokens[rng.randrange(10)] = "danger"
        rows.append((i, label, tokens, "train" if i < 200 else "val" if i < 250 else "test"))
    df = spark.createDataFrame(rows, "id int, label int, tokens array<string>, split string")
    fitted = model.train_classifier(df.where("split = 'train'"), bits=8, iterations=20)
    scores = model.score_batch(fitted, df.where("split = 'test'"))
    assert model.evaluate_scores(scores, 0.5).first()["auc"] > 0.95
    table = {r["token"]: r["weight"] for r in model.token_table(fitted, df).collect()}
    assert max(table, key=table.get) == "danger"
    top = {r["id"]: r["tokens"] for r in model.explain_topk(fitted, df, "id").collect()}
    assert all(top[i] == (["danger"] if label else []) for i, label, _, _ in rows)
    weights = {r["label"]: r["weight"] for r in model.with_class_weight(df).select(
        "label", "weight").distinct().collect()}
    n = sum(r[1] for r in rows)
    assert weights[0] == 1.0 and abs(weights[1] - (300 - n) / n * 1.2) < 1e-9


def test_score_with_user_function(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    got = model.score_with(lambda s: s / 4, df, "x").collect()
    assert [r["prob"] for r in got] == [0.25, 0.75]


def test_token_weights(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"])], "id int, tokens array<string>")
    weights = spark.createDataFrame([("a", 0.5, 2), ("b", 3.0, 1)],
                                    "token string, weight double, n long")
    for count, table in ((None, weights.drop("n")), ("n", weights)):
        got = model.token_weights(df, table, "id", count=count)
        long = got.select("id", F.explode("token_weights").alias("w")).select("id", "w.*")
        assert sorted((r["id"], r["token"], r["weight"]) for r in long.collect()) == [
            (1, "a", 1.0), (1, "b", 3.0), (2, "c", 0.0)]


def test_only_rare_tokens_are_joined_one_by_one(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choices([None, *(f"t{int(rng.paretovariate(0.7))}" for _ in range(9))],
                                                         k=rng.randrange(12))) for _ in range(150)] + [(3, None), (99, [])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    found = Counter(t for _, tokens in rows for t in tokens or () if t is not None)
    table = [(t, None if n == 2 else 1 / n, n) for t, n in found.items() if n != 3] + [(None, 7.0, 1000)]
    weights = spark.createDataFrame(table, "token string, weight double, n long")
    known = {t: w or 0.0 for t, w, _ in table if t is not None}
    expected = {}
    for key, tokens in rows:
        for pos, token in enumerate(tokens or ()):
            times, first = expected.setdefault(key, {}).get(token, (0, pos))
            expected[key][token] = (times + 1, min(first, pos))
    joined, join = [], model.salted_join
    monkeypatch.setattr(model, "salted_join", lambda big, *args: joined.append(big.count()) or join(big, *args))

    def check(count="n"):
        got = model.token_weights(df, weights if count else weights.drop("n"), "id", count=count).collect()
        assert len(got) == len(expected)
        for r in got:
            spots = {w["token"]: (w["weight"], w["pos"]) for w in r["token_weights"]}
            assert len(spots) == len(r["token_weights"])
            assert spots == {t: (known.get(t, 0.0) * times, first) for t, (times, first) in expected[r["id"]].items()}

    check()
    assert joined.pop() == sum(n for n in found.values() if n == 3)     # they have no weight
    monkeypatch.setattr(model, "BLOCK_TOKENS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    check()
    monkeypatch.setattr(model, "COMMON_TOKENS", 4)
    check()
    assert 0 < joined[-1] < found.total() - 4
    monkeypatch.setattr(model, "COMMON_TOKENS", 0)
    check()
    check(None)
    assert joined[-2:] == [found.total()] * 2
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranked_tokens_look_past_the_heaviest(spark):
    """Light long tokens behind many heavy ones that are short, markers or repeats; no weights; ties."""
    many = [("ab", 9.0, i) for i in range(30)] + [("<STR>", 8.0, 1), ("same", 7.0, 2), ("same", 7.0, 3)]
    rows = [(1, [*many, ("low", 0.5, 4), ("nought", None, 5)]), (2, [(f"t{i:02}", 1.0, i) for i in range(60)]),
            (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id int, w array<struct<token string, weight double, pos int>>")
    got = {r["id"]: r["t"] for r in df.select("id", detect.ranked_tokens(F.col("w")).alias("t")).collect()}
    assert got == {1: ["same", "low", "nought"], 2: ["t59", "t58", "t57", "t56", "t55"], 3: [], 4: None}


def test_training_query_trains_with_the_operators_defaults(spark, monkeypatch):
    import __spark_entry__ as entry
    trained = []
    fit = trainer.fit
    monkeypatch.setattr(trainer, "fit", lambda *a, **k: trained.append(fit(*a, **k)) or trained[-1])
    row = entry.queries()["train_and_evaluate"](spark, "/root/testdata/sf0.001").first()
    scorer = trained[0]
    assert scorer.bits == 18 and len(scorer.weights) == 2 ** 19 and len(scorer.epochs) == trainer.ITERATIONS == 50
    assert row["tp"] + row["tn"] + row["fp"] + row["fn"] > 0 and 0.3 <= row["calibrated_threshold"] <= 0.68


def labelled_tokens(spark, n=160):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        tokens = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] + ["bad"] * (label and rng.random() < 0.8)
        rows.append((i, label if i % 50 else None, tokens if i % 31 else None,
                     ("train", "train", "val", "test")[i % 4]))
    return spark.createDataFrame(rows, "id int, label int, tokens array<string>, split string")


def test_rounds_equal_a_plain_trainer_and_the_best_one_stays(spark):
    df = labelled_tokens(spark)
    train, val = (df.where(F.col("split") == s) for s in ("train", "val"))
    scorer = trainer.fit(train, val, bits=6, iterations=12, rate=0.3)
    hashed = [part.where("label is not null").select("label", trainer.hashed_features("tokens", 6).alias("f")).collect()
              for part in (train, val)]
    held = Counter(i for r in hashed[0] for i in set(r["f"]))
    n = len(hashed[0])
    inverse = np.array([math.log((n + 1) / (held[i] + 1)) if held[i] >= 2 else 0 for i in range(128)])
    np.testing.assert_allclose(scorer.inverse, inverse)

    def dense(rows):
        x = np.zeros((len(rows), 128))
        for line, r in zip(x, rows):
            np.add.at(line, r["f"], 1)
        x *= inverse
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norm, out=x, where=norm > 0), np.array([r["label"] for r in rows])
    (x, y), (vx, vy) = dense(hashed[0]), dense(hashed[1])
    up = (n - y.sum()) / y.sum() * 1.2
    w, first, second, plain = np.zeros(129), np.zeros(129), np.zeros(129), []
    for step in range(1, 13):
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        e = np.where(y == 1, up, 1) * (p - y) / n
        slope = np.append(x.T @ e, e.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        w = w - 0.3 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        w[:-1] *= 1 - 0.3 * 1e-4
        q = 1 / (1 + np.exp(-(vx @ w[:-1] + w[-1])))
        said = q >= 0.5
        f1 = 2 * (said & (vy == 1)).sum() / max(1, said.sum() + vy.sum())
        loss = np.mean(-np.where(vy == 1, up, 1) * np.log(np.clip(np.where(vy == 1, q, 1 - q), 1e-7, 1)))
        plain.append((step, f1, loss, w.copy()))
    for epoch, (step, f1, loss, _) in zip(scorer.epochs, plain, strict=True):
        assert epoch["epoch"] == step and abs(epoch["f1"] - f1) < 1e-12 and abs(epoch["val_loss"] - loss) < 1e-7
    best = max(plain, key=lambda e: (e[1], -e[2], -e[0]))
    np.testing.assert_allclose(scorer.weights, best[3][:-1], atol=1e-6)
    assert abs(scorer.bias - best[3][-1]) < 1e-6
    table = scorer.epoch_table(spark)
    assert [r["epoch"] for r in table.where("is_best").collect()] == [best[0]]
    assert evaluate.best_checkpoint(table).first()["epoch"] == best[0]
    got = {r["id"]: r["prob"] for r in model.score_batch(scorer, val.where("label is not null")).collect()}
    want = 1 / (1 + np.exp(-(vx @ scorer.weights + scorer.bias)))
    np.testing.assert_allclose([got[k] for k in sorted(got)], want, atol=1e-12)


def test_training_on_little_or_nothing(spark):
    df = labelled_tokens(spark, 40)
    for rows in (df.limit(0), df.where("label = 1"), df.where("label is null")):
        scorer = trainer.fit(rows, rows, bits=4, iterations=2)
        assert len(scorer.epochs) == 2 and np.isfinite(scorer.weights).all()
        assert all(0 <= r["prob"] <= 1 for r in model.score_batch(scorer, df).collect())


def test_metrics_files_of_a_training(spark, tmp_path):
    split = labelled_tokens(spark).where("label is not null")
    _, metrics = jobs.train_and_evaluate(split, str(tmp_path), "texts", "first", bits=8, iterations=4)
    row = metrics.first()
    back = corpus.read_metrics(spark, f"{tmp_path}/metrics").collect()
    assert len(back) == 1 and (back[0]["corpus"], back[0]["model"]) == ("texts", "first")
    assert all(back[0][c] == row[c] for c in ("tp", "tn", "fp", "fn", "accuracy", "f1", "auc", "mcc", "kappa", "fpr"))
    assert corpus.read_threshold(spark, f"{tmp_path}/training_report").first()[0] == row["calibrated_threshold"]
    report = spark.read.json(f"{tmp_path}/training_report").first()
    assert report["test_f1"] == row["f1"] and report["training_time_seconds"] > 0
    assert spark.read.parquet(f"{tmp_path}/epochs").count() == 4


def test_rows_are_packed_in_blocks(spark):
    rows = [(True, 1, [3, 3, 70_000]), (False, 0, []), (True, 0, [5] * 300 + [3])]
    df = spark.createDataFrame(rows, "is_train boolean, label int, features array<int>").coalesce(1)
    batch = trainer.packed_rows(df).toArrow().to_batches()[0]
    block, = trainer._unpacked(batch)
    assert [*zip(block["feature"], block["row"], block["counts"])] == [(3, 0, 2), (3, 2, 1), (5, 2, 300), (70_000, 0, 1)]
    assert (block["train"].tolist(), block["positive"].tolist()) == ([1, 0, 1], [1, 0, 0])
    inverse, kinds = trainer.inverse_frequencies(trainer.packed_rows(df), 16)
    assert kinds == {(False, False): 1, (False, True): 0, (True, False): 1, (True, True): 1}
    assert inverse[3] == 0 and inverse[5] == 0 and not inverse.any()
