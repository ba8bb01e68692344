"""No size, order or number of tasks changes a result."""

import json
import os

import pytest
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions import checks
from riskloom.operators import curate, detect, evaluate, skew
from riskloom.plans import jobs
from riskloom.sources import corpus, history, tree


def test_tree_is_the_same_for_any_number_of_tasks(spark, tmp_path):
    for name in ("a/x.py", "a/b/y.py", "c/d/e/z.py", "__init__.py", "elsewhere/k.py"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text("pass\n")
    os.symlink(tmp_path / "t" / "elsewhere", tmp_path / "t" / "a" / "link")
    want = sorted(["a/x.py", "a/b/y.py", "c/d/e/z.py", "__init__.py", "elsewhere/k.py"])
    for n in (1, 2, 64):
        assert sorted(r["path"] for r in tree.read_source_tree(spark, str(tmp_path / "t"), n).collect()) == want
        assert len(tree.plan_subtrees(str(tmp_path / "t"), n)) <= n


def test_scan_of_one_file_nothing_and_a_missing_path(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("os.system(x)\n")
    out = jobs.scan_corpus(spark, str(tmp_path / "bad.txt"))
    row = out["findings"].first()
    assert (row["filename"], row["is_vulnerable"]) == ("bad.txt", True)
    (tmp_path / "empty").mkdir()
    summary = jobs.scan_corpus(spark, str(tmp_path / "empty"))["summary"].first()
    assert (summary["total_functions"], summary["security_grade"]) == (0, None)
    with pytest.raises(FileNotFoundError):
        jobs.scan_corpus(spark, str(tmp_path / "absent"))


def scans_and_findings(spark, sizes):
    scans = spark.createDataFrame(
        [(s, 1, "t", "2024-01-01 00:00:00", n, n, 0, n, 1) for s, n in sizes.items()],
        "scan_id long, user_id long, filename string, scan_time string, total_functions int, "
        "vulnerable_count int, safe_count int, high_risk_count int, files_scanned int")
    rows = [(s, 7 * i, f"f{i}", "CWE-78: OS Command Injection", True) for s, n in sizes.items() for i in range(n)]
    findings = spark.createDataFrame(
        rows, "scan_id long, ord long, function_name string, cwe_category string, is_vulnerable boolean")
    return scans, findings


@pytest.mark.parametrize("part", [3, 10_000])
def test_stored_scans_of_any_size(spark, part):
    sizes = {1: 0, 2: 1, 3: 10}
    stored = history.stored_scans(*scans_and_findings(spark, sizes), part=part)
    docs = [(r["scan_id"], r["part_no"], json.loads(r["scan_result_json"])) for r in stored.collect()]
    for scan, n in sizes.items():
        mine = sorted((p, d) for s, p, d in docs if s == scan)
        assert [p for p, _ in mine] == list(range(max(1, -(-n // part))))
        assert all(d["cwe_summary"] == ({"CWE-78: OS Command Injection": n} if n else {}) for _, d in mine)
        assert [f["function_name"] for _, d in mine for f in d["functions"]] == [f"f{i}" for i in range(n)]
    back = corpus.parse_stored_scan(stored.select(F.col("scan_id").alias("id"), "scan_result_json")).collect()
    assert sorted((r["scan_id"], r["ord"], r["function_name"]) for r in back) == sorted(
        (s, i, f"f{i}") for s, n in sizes.items() for i in range(n))


def test_union_keeps_rows_with_long_and_negative_positions(spark):
    texts = [("p" * 70 + str(i), f"code {i}", 0) for i in range(10)]
    long = spark.createDataFrame(texts, "ord string, normalized_code string, label int")
    numbers = spark.createDataFrame([(-5, "b", 1), (3, "b", 1), (-7, "c", 1), (-2**63, "c", 1)],
                                    "ord long, normalized_code string, label int")
    out = curate.union_corpora([long, numbers]).collect()
    assert len(out) == 12 and len({r["ord"] for r in out}) == 12
    kept = sorted(r["ord"] for r in out if r["label"] == 1)
    assert [int(x.split(":")[1]) - 2**63 for x in kept] == [-2**63, -5]


def test_number_all(spark):
    df = spark.range(1_000).select(F.lit("hot").alias("k"), (F.lit(999) - F.col("id")).alias("i"))
    rows = skew.number_all(df.repartition(7), ["k", "i"], "n", "numbers").collect()
    assert all(r["n"] == r["i"] for r in rows) and len(rows) == 1_000


def test_vocabulary_is_measured_and_rows_are_told_apart(spark):
    df = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 1, ["y"])], "file string, fn int, tokens array<string>")
    vocabulary = spark.createDataFrame([("x", 7), ("y", 8)], "token string, id int")
    for limit in (0, 100):
        got = curate.encode_tokens(df, vocabulary, ["file", "fn"], length=3, max_broadcast=limit).collect()
        assert {r["file"]: r["features"] for r in got} == {"a": [7, 8, 0], "b": [8, 0, 0]}


def test_tokens_over_two_lines_hit_no_line(spark):
    df = spark.createDataFrame([("a\nb\nc hit", ["b\nc", "hit"], True), ("a\nbcd\ne", ["bcd\ne"], True)],
                               "code string, suspicious_tokens array<string>, is_vulnerable boolean")
    assert [r["vulnerable_line_no"] for r in detect.locate_line(df).collect()] == [3, 1]


def test_roc_area_of_many_rows(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1)], "prob double, label int")
    assert evaluate.roc_auc(rows).first()["auc"] == 1.0
    products = evaluate.roc_auc(rows)._jdf.queryExecution().analyzed().toString()
    assert "decimal(38,0)" in products


def test_digits_of_any_script(spark):
    df = spark.createDataFrame([("Abcdefg!٣",)], "v string")
    failure, score = df.select(checks.first_failure(F.col("v")), checks.rules_met(F.col("v"))).first()
    assert failure is None and score == 4


def test_threshold_without_a_report(spark, tmp_path):
    assert corpus.read_threshold(spark, str(tmp_path / "none.json")).first()[0] == fixed.DEFAULT_THRESHOLD


@pytest.mark.skipif(not os.environ.get("LARGE_TESTS"), reason="reads 300 MB; set LARGE_TESTS")
def test_diff_document_of_300_mb(spark, tmp_path):
    lines = ["x = 1  # " + "y" * 190] * 500
    with open(tmp_path / "sql.json", "w") as out:
        out.write('{"r": {')
        for i in range(3_000):
            change = {"files": {"f.py": {"changes": [{"badparts": lines, "goodparts": []}]}}}
            out.write((", " if i else "") + f'"{i}": ' + json.dumps(change))
        out.write("}}")
    docs = corpus.read_diff_corpus(spark, str(tmp_path), ["sql"])
    assert corpus.diff_parts(docs).count() == 3_000 * 500


def test_combined_scan_and_report(spark, tmp_path):
    from riskloom.operators import model
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f(q):\n    danger(q)\n    return boom\n\ndef g():\n    os.system(x)\n")
    (tmp_path / "src" / "b.py").write_text("def h(a):\n    calm = a\n    return calm\n")
    rows = [(["danger", "boom", "(", ")"], 1), (["calm", "return"], 0)] * 20
    train = spark.createDataFrame(rows, "tokens array<string>, label int")
    scorer = model.train_classifier(train, bits=8, iterations=5)
    out = jobs.scan_corpus(spark, str(tmp_path / "src"), str(tmp_path / "out"), scorer=scorer, threshold=0.6)
    found = {r["function_name"]: r for r in out["findings"].collect()}
    assert set(found) == {"f", "g", "h"}
    assert found["g"]["is_vulnerable"] and found["g"]["cwe_category"] == "CWE-78: OS Command Injection"
    assert not found["h"]["is_vulnerable"]
    report = "".join(p.read_text() for p in sorted((tmp_path / "out" / "report").glob("part-*")))
    doc = json.loads(report)
    assert (doc["total_functions"], len(doc["findings"])) == (3, 3) and doc["execution_time_seconds"] > 0
    assert [f["function_name"] for f in doc["findings"]] == ["f", "g", "h"]


def test_stored_findings_have_all_keys(spark):
    from riskloom.operators import report
    df = spark.createDataFrame([(1, None, 4)], "ord long, function_name string, start_line int")
    row = report.with_stored_defaults(df).first()
    assert (row["function_name"], row["vulnerable_line_no"], row["risk_level"], row["cwe_category"]) == (
        "unknown", 4, "SAFE", "N/A")
    assert row["remediation"]["title"] == "Security Remediation" and row["suspicious_tokens"] == []
