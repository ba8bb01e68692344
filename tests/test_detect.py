"""Detection, extraction, reports."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions import scoring
from riskloom.operators import detect, extract, report
from riskloom.plans import jobs
from riskloom.sources.corpus import default_vocabulary

MIXED = '''import os
# a comment
def run_shell(cmd):
    os.system(cmd)  # run

def get_user_data(uid):
    cursor.execute("SELECT * FROM users WHERE id = " + uid)

class A:
    def compute_hash(self, data):
        return hashlib.md5(data).hexdigest()

    async def skipped(self):
        def add_numbers(a, b):
            return a + b
'''


def code_rows(spark, *codes):
    return spark.createDataFrame(list(enumerate(codes)), "i int, code string")


def test_verdicts(spark):
    rows = code_rows(
        spark, "def vuln_run(cmd):\n    os.system(cmd)", "def safe_calc(a, b):\n    return a + b",
        "os.system('echo vulnerable')", 'f = open("x")', "f = open(path)", "api_token = 1",
        "x = token", "from a import b\nimport subprocess", "")
    got = {r["i"]: r for r in detect.detect(rows).collect()}
    assert [got[i]["cwe_category"].split(":")[0] for i in range(9)] == [
        "CWE-78", "N/A", "CWE-78", "N/A", "CWE-22", "N/A", "CWE-798", "CWE-78", "N/A"]
    assert got[0]["risk_level"] == "HIGH" and got[1]["risk_level"] == "SAFE"
    assert (got[0]["confidence"], got[1]["confidence"]) == (0.9139, 0.9584)
    assert (got[0]["vulnerable_line_no"], got[0]["vulnerable_line_text"]) == (2, "os.system(cmd)")
    assert got[7]["suspicious_tokens"] == ["subprocess", "FROM"]
    assert got[7]["vulnerable_line_text"] == "from a import b"
    assert got[1]["vulnerable_line_text"] == "" and got[1]["vulnerable_line_no"] == 1
    assert got[0]["remediation"]["title"] == "OS Command Injection Fix"
    assert got[1]["remediation"]["title"] == "General Security Fix"


def test_tokens_add_hits(spark):
    rows = code_rows(spark, "x").withColumn("raw", F.array(F.lit("EVAL")))
    assert detect.match_rules(rows, tokens="raw").first()["matched_tokens"] == ["eval"]


def test_line_location_matches_brute_force(spark):
    import random
    rng = random.Random(3)
    words = ["eval", "x", "open(a", "İ", "md5", "é", "DES", "\n", "\r\n", "\x0b", " ", "from"]
    codes = ["".join(rng.choice(words) + " " for _ in range(rng.randint(1, 20)))
             for _ in range(200)]
    got = detect.locate_line(detect.rule_verdict(detect.match_rules(code_rows(spark, *codes))),
                             start_line=F.lit(10))
    for r in got.collect():
        no, line = 10, ""
        if r["is_vulnerable"]:
            lines = r["code"].splitlines()
            hits = [(i, l) for i, l in enumerate(lines) if any(
                t.lower() in l.lower() and len(t) > 2 for t in r["suspicious_tokens"])]
            i, line = hits[0] if hits else (0, lines[0])
            no, line = 10 + i, line.strip()
        assert (r["vulnerable_line_no"], r["vulnerable_line_text"]) == (no, line), r["code"]


def test_hybrid_bands(spark):
    rows = code_rows(spark, "os.system(x)", "pass", "pass", "pass").withColumn(
        "prob", F.element_at(F.array(F.lit(0.1), F.lit(0.95), F.lit(0.7), F.lit(0.2)),
                             F.col("i") + 1))
    got = {r["i"]: r for r in detect.hybrid_verdict(detect.match_rules(rows)).collect()}
    assert [got[i]["risk_level"] for i in range(4)] == ["LOW", "HIGH", "MEDIUM", "SAFE"]
    assert [got[i]["confidence"] for i in range(4)] == [0.9139, 0.95, 0.7, 0.8]
    assert got[1]["cwe_category"] == fixed.FALLBACK_CWE and got[3]["cwe_category"] == "N/A"


def test_score_hybrid(spark):
    rows = code_rows(spark, "alpha = beta(gamma)", "def run(command):\n    do(command)").withColumn(
        "prob", F.when(F.col("i") == 0, 0.2).otherwise(0.9)).withColumn(
        "raw_tokens", F.when(F.col("i") == 0, F.array(*map(F.lit, ["alpha", "beta", "x", "gamma"])))
        .otherwise(F.array(*map(F.lit, ["def", "run", "command", "do"])))).withColumn(
        "w", F.expr("array(named_struct('token', 'command', 'weight', 2.0D, 'pos', 3))"))
    got = {r["i"]: r for r in detect.score_hybrid(rows, weights="w").collect()}
    assert got[0]["suspicious_tokens"] == ["alpha", "beta", "gamma"]
    assert got[0]["vulnerable_line_text"] == "" and got[0]["risk_level"] == "SAFE"
    assert got[1]["suspicious_tokens"] == ["command", "def", "run"]
    assert got[1]["vulnerable_line_text"] == "def run(command):"
    assert got[1]["remediation"]["title"] == "General Security Fix"


def test_top_and_ranked_tokens(spark):
    weights = [("ab", 9.0, 0), ("abc", 1.0, 1), ("abc", 5.0, 2), ("<NUM>", 8.0, 3),
               ("def", 5.0, 4)]
    raw = ["os", "eval", "system", "cmd", "cmd", "run", "more", "extra"]
    df = spark.createDataFrame([(["eval"], raw, weights)],
                               "a array<string>, raw array<string>, "
                               "w array<struct<token: string, weight: double, pos: int>>")
    got = df.select(detect.top_tokens(F.col("a"), F.col("raw")),
                    detect.top_tokens(F.col("raw"), F.col("a")),
                    detect.ranked_tokens(F.col("w"))).first()
    assert got[0] == ["eval", "system", "cmd", "run", "more"]
    assert got[1] == ["os", "eval", "system", "cmd", "run"]
    assert got[2] == ["def", "abc"]


@pytest.mark.parametrize("vulnerable,total,grade", [
    (0, 5, "A+"), (7, 74, "B"), (25, 100, "C"), (40, 100, "D"), (41, 100, "F"), (0, 0, "A+")])
def test_grade(spark, vulnerable, total, grade):
    df = spark.createDataFrame([(vulnerable, total)], "vulnerable int, total int")
    assert detect.with_grade(df).first()["grade"] == grade


def test_small_display_rules(spark):
    df = spark.createDataFrame([(0, 0, "a" * 21), (1, 3, "b" * 20)], "s int, t int, n string")
    got = df.select(scoring.safety_score(F.col("s"), F.col("t")),
                    scoring.short_name(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(100, "a" * 20 + "..."), (33, "b" * 20)]
    bands = spark.createDataFrame([(0.125,), (0.345,), (0.005,)], "p double")
    assert [r[0] for r in bands.select(scoring.percent(F.col("p"))).collect()] == [12, 34, 0]


def test_extract_functions(spark):
    files = spark.createDataFrame([("a", MIXED), ("b", "x = `n"), ("c", "y = 1"), ("d", "")],
                                  "file_id string, code string")
    rows = extract.extract_functions(files).orderBy("file_id", "fn").collect()
    assert [(r["file_id"], r["name"]) for r in rows] == [
        ("a", "run_shell"), ("a", "get_user_data"), ("a", "compute_hash"), ("a", "add_numbers"),
        ("b", "<module_main>"), ("c", "<module_main>")]
    assert rows[0]["start_line"] == 3 and rows[0]["code"].startswith("def run_shell(cmd):")


def test_scan_files_end_to_end(spark):
    files = spark.createDataFrame([("m.py", bytearray(MIXED.encode()))],
                                  "path string, content binary")
    found = {r["function_name"]: r for r in jobs.scan_files(files).collect()}
    assert {k: v["cwe_category"].split(":")[0] for k, v in found.items()} == {
        "run_shell": "CWE-78", "get_user_data": "CWE-89", "compute_hash": "CWE-327",
        "add_numbers": "N/A"}
    # Lines count in the cleaned code, where the comment line is gone.
    assert found["run_shell"]["start_line"] == 2
    assert found["run_shell"]["vulnerable_line_no"] == 3
    exact = {r["function_name"]: r["cwe_category"]
             for r in jobs.scan_files(files, exact_tokens=True).collect()}
    assert exact == {k: v["cwe_category"] for k, v in found.items()}
    summary = jobs.scan_summary(jobs.scan_files(files), "m.py").first()
    assert (summary["total_functions"], summary["vulnerable_functions"],
            summary["security_grade"]) == (4, 3, "F")


def test_preprocess_encodes(spark):
    files = spark.createDataFrame([("m.py", bytearray(b"def f(x):\n  return os.eval(x)  # c\n"))],
                                  "path string, content binary")
    for exact in (False, True):
        row = jobs.preprocess_files(files, default_vocabulary(spark), exact).first()
        words = "def f ( x ) : return os . eval ( x )".split()
        want = [fixed.DEFAULT_VOCABULARY.index(w) if w in fixed.DEFAULT_VOCABULARY else 1
                for w in words]
        assert row["tokens"] == want + [0] * (200 - len(want))
        assert row["raw_tokens"] == ["def", "f", "x", "return", "os", "eval", "x"]


def test_source_line(spark):
    df = spark.createDataFrame([("# c\n\nx = 1\ny = 2 # d\n", 2)], "source string, start_line int")
    assert extract.with_source_line(df, F.col("source")).first()["source_line"] == 4


def test_segment_blocks(spark):
    code = "x\ndef a:\n  b\n\n  c\ndef d:\n  def e:\n    f\ng"
    df = spark.createDataFrame([(1, code)], "id int, code string")
    rows = extract.segment_blocks(df, "id", "code", r"^\s*def ").orderBy("block").collect()
    assert [(r["start_line"], r["n_lines"]) for r in rows] == [(2, 4), (6, 3), (7, 2)]


def finding_rows(spark):
    base = detect.detect(code_rows(spark, "os.system(a)", "pass", "md5(b)", "eval(c)"))
    return base.select(
        F.lit(1).alias("scan_id"), (F.col("i") * 10).cast("bigint").alias("ord"),
        F.when(F.col("i") % 2 == 0, "b.py").otherwise("a.py").alias("filename"),
        F.format_string("f%d", "i").alias("function_name"), F.lit(1).alias("start_line"),
        "is_vulnerable", "risk_level", "confidence_percent", "cwe_category",
        "suspicious_tokens", "vulnerable_line_no", "vulnerable_line_text", "remediation",
        F.col("code").alias("function_code"))


def test_anonymise(spark):
    rows = report.anonymise_findings(finding_rows(spark), chunk=7).orderBy("ord").collect()
    assert [r["filename"] for r in rows] == ["File 1", "File 2", "File 1", "File 2"]
    assert "function_code" not in rows[0].asDict() and rows[0]["vulnerable_line_text"]
    hidden = report.anonymise_findings(finding_rows(spark), chunk=7, redact_lines=True)
    assert {r["vulnerable_line_text"] for r in hidden.collect()} == {""}
    names = spark.createDataFrame([(1,), (2,)], "n int").select(report.target_name(F.col("n")))
    assert [r[0] for r in names.collect()] == [
        "Anonymized Target (1 file)", "Anonymized Target (2 files)"]


def test_report_document(spark):
    scans = spark.createDataFrame([(1, "proj", "2024-01-01 00:00:00", 4, 3, 1)],
                                  "scan_id int, filename string, scan_time string, "
                                  "total_functions int, vulnerable_count int, safe_count int")
    lines = [r["line"] for r in report.report_lines(scans, finding_rows(spark), 15).orderBy(
        "section", "item", "line_no").collect()]
    assert lines[2:5] == ["File: proj", "Scan Time: 2024-01-01 00:00:00",
                          "Total Functions Analysed: 4"]
    at = lines.index("VULNERABLE FUNCTIONS")
    assert lines[at + 2:at + 8] == [
        "[1] f0 -- Line 1", "    Risk Level: HIGH", "    Confidence: 91%",
        "    CWE Category: CWE-78: OS Command Injection", "    Suspicious Tokens: os.system", ""]
    assert [l for l in lines if l.startswith("[")] == [
        "[1] f0 -- Line 1", "[2] f2 -- Line 1", "[3] f3 -- Line 1"]
    assert lines[-4:] == ["-" * 14, "f1 -- Line 1 -- Confidence: 96%", "", report.REPORT_FOOTER]


def test_sarif_document(spark):
    lines = report.sarif_lines(finding_rows(spark)).orderBy("section", "item").collect()
    doc = json.loads("".join(r["line"] for r in lines))
    run = doc["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["CWE-78", "CWE-327"]
    assert [(r["ruleId"], r["level"]) for r in run["results"]] == [
        ("CWE-78", "error"), ("CWE-327", "error"), ("CWE-78", "error")]
    place = run["results"][0]["locations"][0]["physicalLocation"]
    assert place == {"artifactLocation": {"uri": "b.py"}, "region": {"startLine": 1}}


def test_cli_report_document(spark):
    summary = spark.createDataFrame([("/x", "F", 4, 3, 0.5)],
                                    "target string, security_grade string, total_functions int, "
                                    "vulnerable_functions int, execution_time_seconds double")
    lines = report.cli_report_lines(summary, finding_rows(spark)).orderBy("section", "item")
    doc = json.loads("".join(r["line"] for r in lines.collect()))
    assert doc["security_grade"] == "F" and len(doc["findings"]) == 4
    assert doc["findings"][2]["function_name"] == "f2"
    assert list(doc["findings"][0]) == list(report.FINDING_COLUMNS)


def test_profile_agrees_with_counters(spark):
    found = finding_rows(spark)
    profile = detect.scan_profile(found, ["scan_id"], "filename", [
        "CWE-327: Insecure Cryptographic Implementation", "CWE-78: OS Command Injection"]).first()
    counters = detect.scan_counters(found, ["scan_id"], "filename").first()
    for name in ("total", "vulnerable", "safe", "high_risk", "files"):
        assert profile[name] == counters[name]
    assert (profile["cwes"], profile["top_cwe"]) == (2, "CWE-78: OS Command Injection")
    order = [r["cwe_id"] for r in detect.cwe_distribution(found, order="ord").collect()]
    assert order == ["CWE-78", "CWE-327"]
