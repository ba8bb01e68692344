"""Curation, split, vocabulary, encoding, skew helpers."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions import text
from riskloom.operators import curate, skew


def labelled(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "ord long, code string, language string, safety string")


ROWS = [("print('hello')", "py", "safe"), (" print('hello')\n", "Python", " SAFE"),
        ("print('hello') ", "js", "Vulnerable"), ("x = 1 + 2 + 3", None, "vulnerable"),
        ("x = 1 + 2 + 3", "py", "vulnerable"), ("short", "py", "safe"),
        (None, "py", "safe"), ("y = 1 + 2 + 3", "py", None), ("z = 1 + 2 + 3", "py", "maybe")]


def test_clean_labelled(spark):
    rows = curate.clean_labelled(labelled(spark, ROWS)).orderBy("ord").collect()
    assert [(r["ord"], r["language"], r["label"]) for r in rows] == [
        (0, "py", 0), (1, "python", 0), (2, "js", 1), (3, "other", 1), (4, "py", 1)]


def test_conflicts_and_copies(spark):
    clean = curate.clean_labelled(labelled(spark, ROWS))
    kept = curate.drop_conflicting(clean)
    assert sorted(r["ord"] for r in kept.collect()) == [3, 4]
    assert [r["ord"] for r in curate.dedupe_first(kept).collect()] == [3]
    assert [r["ord"] for r in curate.resolve_copies(clean).collect()] == [3]
    assert sorted(r["ord"] for r in curate.dedupe_first(clean).collect()) == [0, 2, 3]


def test_dedupe_is_idempotent_and_order_free(spark):
    rng = random.Random(1)
    rows = [(f"code number {rng.randint(0, 20)}", "py", rng.choice(["safe", "vulnerable"]))
            for _ in range(300)]
    clean = curate.clean_labelled(labelled(spark, rows))
    once = curate.dedupe_first(clean)
    ids = sorted(r["ord"] for r in once.collect())
    assert sorted(r["ord"] for r in curate.dedupe_first(once).collect()) == ids
    mixed = clean.orderBy(F.desc("ord")).repartition(3)
    assert sorted(r["ord"] for r in curate.dedupe_first(mixed).collect()) == ids


def test_normalise_and_slice(spark):
    df = spark.createDataFrame([("x = 'a' # c\ny = 12", "py"), ("// only", "js"), ("b", "c++")],
                               "code_clean string, language string")
    rows = curate.normalise(df).collect()
    assert rows[0]["normalized_code"] == "x = <STR> \ny = <NUM>"
    assert rows[0]["tokens"] == ["x", "=", "<STR>", "y", "=", "<NUM>"]
    assert len(rows) == 2
    assert curate.language_slice(df, "python").count() == 1
    assert curate.language_slice(df, None).count() == 3


def test_union_keeps_first_part_and_contradictions(spark):
    first = spark.createDataFrame([(5, "a", 1), (6, "b", 0)],
                                  "ord long, normalized_code string, label int")
    second = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 0, "y"), (3, "c", 0, "z")],
                                   "ord long, normalized_code string, label int, cwe string")
    got = curate.union_corpora([first, second]).select("normalized_code", "label", "cwe")
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == [
        ("a", 0, "y"), ("a", 1, None), ("b", 0, None), ("c", 0, "z")]
    strict = curate.union_corpora([first, second], drop_conflicts=True)
    assert sorted(r["normalized_code"] for r in strict.collect()) == ["b", "c"]


@pytest.mark.parametrize("positives,negatives,sizes", [
    (600, 663, (884, 189, 190)), (1, 2, (2, 0, 1)), (50, 0, (35, 7, 8)), (500, 3, None)])
def test_split_sizes(spark, positives, negatives, sizes):
    rows = [(i, int(i < positives)) for i in range(positives + negatives)]
    df = spark.createDataFrame(rows, "id long, label int")
    split = curate.stratified_split(df, "id", digits=1).collect()
    assert len(split) == len(rows) == len({r["id"] for r in split})
    total = {s: sum(r["split"] == s for r in split) for s in ("train", "val", "test")}
    if sizes:
        assert tuple(total.values()) == sizes
    for label, n in ((1, positives), (0, negatives)):
        share = sum(r["split"] == "train" and r["label"] == label for r in split)
        assert abs(share - n * total["train"] / len(rows)) <= 1
    again = curate.stratified_split(df.repartition(3), "id", digits=2).collect()
    assert {r["id"]: r["split"] for r in again} == {r["id"]: r["split"] for r in split}


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(1, ["a", "a", "<STR>", "b"]), (2, ["a", "<STR>", "c"]), (3, [])],
                               "id int, tokens array<string>")
    vocab = curate.build_vocabulary(df, max_size=10)
    got = {r["token"]: r["id"] for r in vocab.collect()}
    # Three places are free; the marker among the top three uses one of them.
    assert got == {**{t: i for i, t in enumerate(fixed.RESERVED_TOKENS)}, "a": 7, "b": 8}
    for limit in (100_000, 5):
        rows = curate.encode_tokens(df, vocab, "id", length=4, max_broadcast=limit).collect()
        assert {r["id"]: r["features"] for r in rows} == {
            1: [7, 7, 2, 8], 2: [7, 2, 1, 0], 3: [0, 0, 0, 0]}


def test_summary_audit_weight(spark):
    df = spark.createDataFrame([("train", 1, 4), ("train", 0, 5), ("val", 0, 8)],
                               "split string, label int, token_length int")
    got = {r["split"]: r for r in curate.dataset_summary(df).collect()}
    assert got["train"]["median_length"] == 4.5 and got["all"]["total"] == 3
    assert curate.class_weight(df).first().asDict() == {
        "n_vulnerable": 1, "n_safe": 2, "pos_weight": 2.0, "loss_weight": 2.4}
    audit = spark.createDataFrame([("a", "x"), ("a", " x\n"), ("b", "x")], "k string, code string")
    assert sorted(tuple(r) for r in curate.copy_audit(audit, ["k"]).collect()) == [
        ("a", 2, 1, 1), ("b", 1, 1, 0)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", [None, 50])
def test_salted_join_equals_plain_join(spark, how, hot):
    rng = random.Random(2)
    big = spark.createDataFrame([(i, 0 if i % 3 == 0 else rng.randint(1, 30))
                                 for i in range(600)], "id long, k int")
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    small = counts.where("k % 2 = 0").withColumn("v", F.col("k") * 10)
    count = None if hot is None else "n"
    right = small if count else small.drop("n")
    got = skew.salted_join(big, right, ["k"], how, ["id"], count, hot_rows=hot)
    want = big.join(small.drop("n"), ["k"], how)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(
        map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("hot_rows", [1, 150, 10 ** 6])
def test_number_rows_equals_window(spark, hot_rows):
    rng = random.Random(4)
    rows = [(g, p) for g, n in (("a", 200), ("b", 149), (None, 30)) for p in rng.sample(range(-500, 500), n)]
    df = spark.createDataFrame(rows, "g string, p long")
    got = skew.number_rows(df, ["g"], "p", "n", chunk=37, hot_rows=hot_rows)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("p")))
    assert sorted(map(tuple, got.select("g", "p", "n").collect()), key=repr) == sorted(
        map(tuple, want.collect()), key=repr)


def audited_rows():
    rng = random.Random(9)
    return [(rng.choice("xyz"), rng.choice(["py", "Python", "c", None]),
             rng.choice(["safe", "vulnerable", "Safe", None]),
             rng.choice([None, "", " a ", "a", *(f"t{i}" for i in range(40))])) for _ in range(600)]


def plain_audit(rows):
    out = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        inside = [r for r in mine if r[1] and r[1].lower() in ("py", "python")]
        texts = [r[3].strip() for r in inside if r[2] is not None and r[3] is not None]
        out[key] = (len(mine), len(inside), sum(r[2] == "safe" for r in inside),
                    sum(r[2] == "vulnerable" for r in inside), len(set(texts)), len(texts) - len(set(texts)))
    return out


def test_raw_audit_equals_plain_counts(spark):
    rows, schema = audited_rows(), "k string, language string, safety string, code string"
    df = spark.createDataFrame(rows, schema)
    got = {r[0]: tuple(r)[1:] for r in curate.raw_audit(df, ["k"]).collect()}
    assert got == plain_audit(rows)
    hashed = df.withColumn("code", text.sha256_stripped(F.col("code")))
    assert {r[0]: tuple(r)[1:] for r in curate.raw_audit(hashed, ["k"], digest="code").collect()} == got
    assert tuple(curate.raw_audit(df).first()) == plain_audit([("", *r[1:]) for r in rows])[""]
    assert tuple(curate.raw_audit(df.limit(0)).first()) == (0, 0, 0, 0, 0, 0)


def test_stored_audits_are_merged_without_texts(spark, tmp_path):
    schema = "k string, language string, safety string, code string, day int"
    rows = [(*r, i % 4) for i, r in enumerate(audited_rows())]
    # Sketches of few texts are exact, whatever they are merged from.
    curate.audit_sketches(spark.createDataFrame(rows, schema), ["k", "day"]).write.parquet(str(tmp_path / "audits"))
    stored, want = spark.read.parquet(str(tmp_path / "audits")), plain_audit(rows)
    for r in curate.merge_audits(stored, ["k"]).collect():
        exact = want[r["k"]]
        assert (r["records"], r["slice_rows"], r["safe"], r["vulnerable"]) == exact[:4]
        assert (r["unique_estimate"], r["duplicates_estimate"]) == exact[4:]
    # Many texts: two sources of 60,000 share 20,000. Four standard errors are allowed.
    many = spark.range(120_000).select(
        F.when(F.col("id") < 60_000, "a").otherwise("b").alias("k"), F.lit("py").alias("language"),
        F.lit("safe").alias("safety"),
        F.when(F.col("id") < 80_000, F.col("id") % 60_000).otherwise(F.col("id")).cast("string").alias("code"))
    large = curate.audit_sketches(many, ["k"])
    error = 4 / 2 ** 7
    total = curate.merge_audits(large).first()["unique_estimate"]
    assert abs(total - 100_000) < error * 100_000
    both = curate.audit_overlap(large, "k", "a", "b").first()
    assert abs(both["all_texts"] - 100_000) < error * 100_000
    assert abs(both["common_texts"] - 20_000) < error * 100_000
    assert abs(both["first_texts"] - 60_000) < error * 60_000


def test_a_cut_is_refined_until_few_rows_are_ranked(spark):
    rows = [(i, i % 10 == 0) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, label boolean")
    whole = curate.stratified_split(df, "id", digits=1, most=10**9).collect()
    for digits, most in ((1, 5), (1, 1), (2, 3)):
        fine = curate.stratified_split(df.repartition(3), "id", digits=digits, most=most).collect()
        assert {r["id"]: r["split"] for r in fine} == {r["id"]: r["split"] for r in whole}
    sizes = [sum(r["split"] == s for r in whole) for s in ("train", "val", "test")]
    assert sizes == [2_100, 450, 450]
    # Repeated keys cannot be told apart by digits: the search ends all the same.
    same = spark.createDataFrame([(7, True)] * 40, "id long, label boolean")
    assert curate.stratified_split(same, "id", digits=16, most=1).count() == 40


def test_queries_of_two_passes_write_their_tokens_once(spark, monkeypatch):
    import __spark_entry__ as entry
    from riskloom.plans import jobs
    written, settle = [], jobs.settle
    monkeypatch.setattr(jobs, "settle", lambda df, name: written.append(name) or settle(df, name))
    for name in ("encode_pad", "attribution_topk"):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert written == ["tokens", "tokens"]
