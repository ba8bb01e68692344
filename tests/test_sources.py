"""Trees, archives, corpora, artefacts, sinks, end-to-end jobs."""

import json
import zipfile

from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.operators import curate, detect
from riskloom.plans import jobs
from riskloom.sources import corpus, history, sinks, tree

CODE = "def f(cmd):\n    os.system(cmd)\n"


def make_tree(root):
    files = {"a.py": CODE.encode(), "__init__.py": b"", "_priv/z.py": b"x = 1\n",
             "pkg/sub/B.PY": "s = 'café'\n".encode("latin-1"), "pkg/note.txt": b"no",
             "venv/skip.py": b"x", ".git/skip.py": b"x", "pkg/__pycache__/skip.py": b"x",
             "pkg/.hidden/skip.py": b"x", "foo.egg-info/k.py": b"\xef\xbb\xbfx = 2\r\ny = 3\r\n"}
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return ["__init__.py", "_priv/z.py", "a.py", "foo.egg-info/k.py", "pkg/sub/B.PY"]


def test_source_tree(spark, tmp_path):
    wanted = make_tree(tmp_path)
    for partitions in (1, 2, 100):
        files = tree.read_source_tree(spark, str(tmp_path), partitions)
        assert sorted(r["path"] for r in files.collect()) == wanted
    text = {r["path"]: r["s"] for r in files.select(
        "path", tree.decode_source(F.col("content")).alias("s")).collect()}
    assert text["pkg/sub/B.PY"] == "s = 'café'\n"
    assert text["foo.egg-info/k.py"] == "﻿x = 2\ny = 3\n" and text["__init__.py"] == ""


def test_archives(spark, tmp_path):
    path = tmp_path / "p.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a/x.py", CODE)
        z.writestr("venv/y.py", CODE)
        z.writestr("n.txt", "no")
        z.writestr("a/z.py", CODE * 50)
    raw = bytearray(path.read_bytes())
    raw[raw.rindex(CODE.encode()) + 5] ^= 1  # the last member no longer fits its checksum
    path.write_bytes(raw)
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    names = spark.createDataFrame([(str(path),), (str(tmp_path / "bad.zip"),)], "path string")
    rows = tree.read_source_archives(spark, names).collect()
    assert {r["path"]: r["content"] and bytes(r["content"]).decode() for r in rows} == {"a/x.py": CODE, "a/z.py": None}
    assert [r["path"] for r in tree.with_code(tree.read_source_archives(spark, names)).where("code <> ''").collect()] == [
        "a/x.py"]


def test_scan_corpus(spark, tmp_path):
    make_tree(tmp_path / "src")
    out = jobs.scan_corpus(spark, str(tmp_path / "src"), str(tmp_path / "out"))
    summary = out["summary"].first()
    assert (summary["total_functions"], summary["vulnerable_functions"]) == (4, 1)
    assert summary["security_grade"] == "C"
    found = spark.read.json(str(tmp_path / "out/findings"))
    assert found.where("is_vulnerable").first()["filename"] == "a.py"


def test_labelled_csv_and_curation(spark, tmp_path):
    rows = [(f'def f{i}():\n    return "a, ""b"" {i}"', "py", "safe" if i % 3 else "vulnerable")
            for i in range(40)]
    quoted = "\n".join(",".join('"' + v.replace('"', '""') + '"' for v in r) for r in rows)
    (tmp_path / "c.csv").write_text("code,language,safety\n" + quoted + "\n")
    df = jobs.load_labelled(spark, str(tmp_path / "c.csv"))
    assert [r["code"] for r in df.orderBy("ord").collect()] == [r[0] for r in rows]
    summary = {r["split"]: r for r in jobs.curate_corpus(df, str(tmp_path / "o")).collect()}
    total = {s: summary[s]["total"] for s in summary}
    assert total == {"train": 28, "val": 6, "test": 6, "all": 40}
    splits = corpus.load_splits(spark, str(tmp_path / "o/encoded"))
    assert splits["train"].count() == 28
    assert len(splits["val"].first()["features"]) == fixed.SEQUENCE_LENGTH
    vocab = corpus.read_vocabulary(spark, str(tmp_path / "o/vocabulary"))
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert ids["<STR>"] == 2 and sorted(ids.values()) == list(range(len(ids)))
    doc = spark.read.json(str(tmp_path / "o/summary")).first()
    assert (doc["raw_rows"], doc["raw_samples"], doc["target_samples"]) == (40, 40, 40)
    assert doc["vocabulary_size"] == len(ids) and doc["splits"]["train"]["total"] == 28
    assert doc["token_length_stats"]["median"] == 9.0
    assert spark.read.option("multiLine", True).csv(str(tmp_path / "o/clean")).count() > 0
    only_train = jobs.curate_corpus(df, str(tmp_path / "o2"), fit_on="train").count()
    assert only_train == 4


DIFF = {"repo1": {"c1": {"files": {"a.py": {"changes": [
    {"badparts": [["os.system(cmd + x)", "return 1"], "eval(user_input)"],
     "goodparts": [["subprocess.run([cmd])"]]}]}}}},
    "repo2": {"c9": {"files": {"b.py": {"changes": [
        {"badparts": [["short"]], "goodparts": ["eval(user_input)", 12345678901234]},
        {"badparts": []}]}}}, "c8": {"note": 1}}}


def test_diff_corpus(spark, tmp_path):
    (tmp_path / "plain_sql").write_text(json.dumps(DIFF))
    (tmp_path / "other").write_text("{}")
    docs = corpus.read_diff_corpus(spark, str(tmp_path))
    parts = corpus.diff_parts(docs)
    got = sorted((r["repo"], r["commit"], r["side"], r["code"]) for r in parts.collect())
    assert got == [("repo1", "c1", "bad", "eval(user_input)"),
                   ("repo1", "c1", "bad", "os.system(cmd + x)\nreturn 1"),
                   ("repo1", "c1", "good", "subprocess.run([cmd])"),
                   ("repo2", "c9", "bad", "short"), ("repo2", "c9", "good", "12345678901234"),
                   ("repo2", "c9", "good", "eval(user_input)")]
    snippets = jobs.diff_snippets(docs).select("code_clean", "label", "cwe").collect()
    # The contradictory snippet is gone, and so is the short one.
    assert sorted(map(tuple, snippets)) == [
        ("12345678901234", 0, "CWE-89: SQL Injection"),
        ("os.system(cmd + x)\nreturn 1", 1, "CWE-89: SQL Injection"),
        ("subprocess.run([cmd])", 0, "CWE-89: SQL Injection")]


def test_merged_corpus(spark, tmp_path):
    (tmp_path / "plain_xss").write_text(json.dumps(DIFF))
    rows = [(i, f"value_{i} = compute()", "py", "safe" if i % 2 else "vulnerable")
            for i in range(20)] + [(20, "subprocess.run([cmd])", "py", "safe")]
    labelled = spark.createDataFrame(rows, "ord long, code string, language string, "
                                           "safety string")
    summary = jobs.curate_diff_corpus(corpus.read_diff_corpus(spark, str(tmp_path)), labelled,
                                      str(tmp_path / "o"))
    assert {r["split"]: r["total"] for r in summary.collect()}["all"] == 23
    doc = spark.read.json(str(tmp_path / "o/summary")).first()
    assert (doc["snippets"], doc["combined_samples"]) == (3, 23)
    assert doc["category_distribution"]["CWE-79: Cross-Site Scripting (XSS)"] == 3
    out = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
           .csv(str(tmp_path / "o/normalised")))
    assert {r["source_category"]: r["count"] for r in out.groupBy("source_category").count()
            .collect()} == {"plain_xss": 3, "labelled": 20}


def test_json_artefacts(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"calibrated_threshold": 0.44, "x": 1}')
    (tmp_path / "bad.json").write_text("not json")
    read = lambda n: corpus.read_threshold(spark, str(tmp_path / n)).first()[0]
    assert read("t.json") == 0.44 and read("bad.json") == fixed.DEFAULT_THRESHOLD
    (tmp_path / "m.json").write_text(json.dumps({"set": {
        "one": {"TP": 1, "auc": 0.5, "f1": 0.25}, "two": {"TP": 2, "auc": "N/A", "mcc": 0.1}}}))
    got = {r["model"]: r for r in corpus.read_metrics(spark, str(tmp_path / "m.json")).collect()}
    assert got["one"]["tp"] == 1 and got["one"]["auc"] == 0.5 and got["two"]["auc"] is None
    (tmp_path / "a.json").write_text(json.dumps([{"function_name": "f", "tokens_with_weights": [
        {"token": "x", "weight": 0.5, "role": "r"}, {"token": "y", "weight": 0.1, "role": "s"}]}]))
    rows = corpus.read_attributions(spark, str(tmp_path / "a.json")).orderBy("pos").collect()
    assert [(r["token"], r["weight"]) for r in rows] == [("x", 0.5), ("y", 0.1)]
    default = {r["token"]: r["id"] for r in corpus.read_vocabulary(spark).collect()}
    assert len(default) == 100 and default["api_key"] == 39 and default["}"] == 99


def test_history_round_trip(spark, tmp_path):
    found = detect.detect(spark.createDataFrame([(0, "os.system(x)"), (1, "pass")],
                                                "i int, code string"))
    findings = found.select(
        F.lit(7).cast("bigint").alias("scan_id"), F.col("i").cast("bigint").alias("ord"),
        F.lit("real/name.py").alias("filename"), F.lit("f").alias("function_name"),
        F.lit(1).alias("start_line"), "vulnerable_line_no", "vulnerable_line_text",
        "is_vulnerable", "confidence", "confidence_percent", "cwe_category",
        "suspicious_tokens", "risk_level", "remediation", F.col("code").alias("function_code"))
    scans = spark.createDataFrame([(7, 3, "secret", "2024-01-01 00:00:00", 2, 1, 1, 1, 1)],
                                  "scan_id long, user_id long, filename string, "
                                  "scan_time string, total_functions int, vulnerable_count int, "
                                  "safe_count int, high_risk_count int, files_scanned int")
    history.append_scans(scans, findings, str(tmp_path), chunk=10)
    kept = spark.read.parquet(str(tmp_path / "scan_findings")).collect()
    assert {r["filename"] for r in kept} == {"File 1"}
    assert spark.read.parquet(str(tmp_path / "scan_history")).first()["filename"] == (
        "Anonymized Target (1 file)")
    stored = history.stored_scans(scans, findings.drop("function_code"))
    back = corpus.parse_stored_scan(stored.select(F.col("scan_id").alias("id"),
                                                  "scan_result_json")).orderBy("ord").collect()
    assert [r["cwe_category"] for r in back] == ["CWE-78: OS Command Injection", "N/A"]
    assert back[0]["remediation"]["title"] == "OS Command Injection Fix"
    events = spark.createDataFrame([(1, None, "LOGIN", "", None, "d")], history.SCHEMAS["audit_log"])
    history.append_audit(events, str(tmp_path))
    tables = history.SCHEMAS.keys()
    spark.createDataFrame([], history.SCHEMAS["users"]).write.parquet(str(tmp_path / "users"))
    assert set(history.read_history(spark, str(tmp_path))) == set(tables)
    assert spark.read.parquet(str(tmp_path / "audit_log")).count() == 1


def test_record_scan(spark, tmp_path):
    files = spark.createDataFrame(
        [("app/utils.py", bytearray(CODE.encode())),
         ("app/models.py", bytearray(b"def g():\n    return 1\ndef h(q):\n    eval(q)\n"))],
        "path string, content binary")
    spark.createDataFrame([], history.SCHEMAS["users"]).write.parquet(str(tmp_path / "users"))
    jobs.record_scan(jobs.scan_files(files), 11, 3, "app", str(tmp_path), "1.2.3.4")
    tables = history.read_history(spark, str(tmp_path))
    scan = tables["scan_history"].first()
    assert (scan["id"], scan["user_id"], scan["filename"], scan["is_deleted"]) == (
        11, 3, "Anonymized Target (2 files)", 0)
    assert (scan["total_functions"], scan["vulnerable_count"], scan["safe_count"]) == (3, 2, 1)
    doc = json.loads(scan["scan_result_json"])
    assert doc["cwe_summary"] == {"CWE-78: OS Command Injection": 2}
    assert sorted({f["filename"] for f in doc["functions"]}) == ["File 1", "File 2"]
    assert "utils.py" not in scan["scan_result_json"] and "def g" not in scan["scan_result_json"]
    assert tables["audit_log"].first()["details"] == "Target: app (2 files), Vulnerable: 2"
    back = corpus.parse_stored_scan(tables["scan_history"])
    assert sorted(r["function_name"] for r in back.collect()) == ["f", "g", "h"]


def test_line_and_csv_sinks(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "n int, line string")
    sinks.write_lines(lines, str(tmp_path / "l"), ["n"])
    parts = sorted((tmp_path / "l").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "a\nb\nc\n"
    enc = spark.createDataFrame([("train", [1, 0], 1)], "split string, features array<int>, label int")
    sinks.write_splits(enc, [str(tmp_path / "s1"), str(tmp_path / "s2")])
    assert corpus.load_splits(spark, str(tmp_path / "s2"))["train"].count() == 1
    sinks.write_vocabulary(corpus.default_vocabulary(spark), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 100
    assert curate.value_counts(enc, "split").first()["n"] == 1


def test_only_the_wanted_fields_of_stored_findings(spark):
    doc = '{"first_position": 5, "functions": [{"start_line": 3, "remediation": {"title": "t"}, "function_name": "f"}]}'
    df = spark.createDataFrame([(1, doc), (2, "{}")], "id long, scan_result_json string")
    got = corpus.parse_stored_scan(df, fields=("function_name", "start_line"))
    assert got.columns == ["scan_id", "ord", "function_name", "start_line"]
    assert [tuple(r) for r in got.collect()] == [(1, 5, "f", 3)]
