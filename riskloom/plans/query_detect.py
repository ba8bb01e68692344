"""Registered queries: detection, scan summaries, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import scoring, text
from ..operators import detect, extract, report
from ..operators.skew import number_rows
from ..sources import history
from ..sources.corpus import parse_stored_scan
from . import tables as t
from .registry import query

RULES = t.rule_ctes() | {"verdict": t.VERDICT}
WORDS = t.rule_ctes(t.WORD_RULES) | {"verdict": t.VERDICT}
HIT_COLUMNS = ("SELECT doc_id, n_hits, first_token, cwe_category, is_vulnerable, "
               "coalesce(hits, '') AS hits FROM verdict")


def _hits(spark, base, rules):
    found = detect.rule_verdict(detect.match_rules(t.source_files(spark, base), "code", rules))
    return found.select("doc_id", F.size("matched_tokens").alias("n_hits"),
                        F.get("matched_tokens", F.lit(0)).alias("first_token"),
                        "cwe_category", "is_vulnerable",
                        F.array_join("matched_tokens", ",").alias("hits"))


def verdicts(spark, base, rules=fixed.DEFAULT_RULES):
    return detect.rule_verdict(detect.match_rules(t.source_files(spark, base), "code", rules))


@query("rule_hits", t.with_ctes((), HIT_COLUMNS, **RULES))
def rule_hits(spark, base):
    return _hits(spark, base, fixed.DEFAULT_RULES)


@query("rule_hits_custom", t.with_ctes((), HIT_COLUMNS, **WORDS))
def rule_hits_custom(spark, base):
    return _hits(spark, base, t.WORD_RULES)


@query("detect_documents", t.with_ctes((), (
    "SELECT doc_id, is_vulnerable, cwe_category, risk_level, "
    "CASE WHEN is_vulnerable THEN 0.9139::DOUBLE ELSE 0.9584::DOUBLE END AS confidence, "
    "CASE WHEN is_vulnerable THEN 91 ELSE 96 END AS confidence_percent FROM verdict"), **RULES))
def detect_documents(spark, base):
    return verdicts(spark, base).select("doc_id", "is_vulnerable", "cwe_category", "risk_level",
                                        "confidence", "confidence_percent")


LOCATE = {
    "top5": "SELECT doc_id, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id "
            "ORDER BY rank) AS rn FROM hits) WHERE rn <= 5 AND length(token) > 2",
    "lines": "SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM "
             "(SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IN "
             "(SELECT doc_id FROM hits))",
    "firsts": "SELECT l.doc_id, min(pos) AS pos, arg_min(line, pos) AS line FROM lines l JOIN "
              "top5 t ON l.doc_id = t.doc_id AND contains(lower(line), lower(token)) GROUP BY 1",
}


def _located(spark, base, rules):
    return detect.locate_line(verdicts(spark, base, rules)).select(
        "doc_id", "vulnerable_line_no", "vulnerable_line_text")


LOCATE_SQL = ("SELECT v.doc_id, coalesce(pos, 1)::INT AS vulnerable_line_no, CASE WHEN "
              f"is_vulnerable THEN {t.strip_sql('coalesce(line, string_split(code, chr(10))[1])')}"
              " ELSE '' END AS vulnerable_line_text FROM verdict v LEFT JOIN firsts f ON "
              "v.doc_id = f.doc_id")


@query("locate_line", t.with_ctes((), LOCATE_SQL, **RULES, **LOCATE))
def locate_line(spark, base):
    return _located(spark, base, fixed.DEFAULT_RULES)


@query("locate_line_custom", t.with_ctes((), LOCATE_SQL, **WORDS, **LOCATE))
def locate_line_custom(spark, base):
    return _located(spark, base, t.WORD_RULES)


@query("top_tokens", t.with_ctes((), (
    "SELECT d.doc_id, coalesce(CASE WHEN least(coalesce(n, 0), 5) < 3 THEN a.toks ELSE b.toks "
    "END, '') AS tokens FROM documents d LEFT JOIN few n ON d.doc_id = n.doc_id LEFT JOIN both5 a "
    "ON d.doc_id = a.doc_id LEFT JOIN hits5 b ON d.doc_id = b.doc_id"), **WORDS,
    few="SELECT doc_id, count(*) AS n FROM hits GROUP BY 1",
    hits5="SELECT doc_id, string_agg(token, ',' ORDER BY rank) AS toks FROM (SELECT *, "
          "row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS rn FROM hits) WHERE rn <= 5 "
          "GROUP BY 1",
    raw="SELECT doc_id, tok, min(pos) AS pos FROM (SELECT doc_id, unnest(ts) AS tok, "
        "generate_subscripts(ts, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, "
        "'[A-Za-z_][A-Za-z0-9_]*') AS ts FROM documents)) WHERE length(tok) > 2 GROUP BY ALL",
    either="SELECT doc_id, tok, min(pos) AS pos FROM (SELECT doc_id, tok, pos FROM raw UNION ALL "
           "SELECT doc_id, token AS tok, rank - 1000 AS pos FROM hits) GROUP BY 1, 2",
    both5="SELECT doc_id, string_agg(tok, ',' ORDER BY pos) AS toks FROM (SELECT *, "
          "row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM either) WHERE rn <= 5 "
          "GROUP BY 1"))
def top_tokens(spark, base):
    found = detect.match_rules(t.source_files(spark, base), "code", t.WORD_RULES)
    top = detect.top_tokens(F.col("matched_tokens"), text.display_tokens(F.col("code")))
    return found.select("doc_id", F.array_join(top, ",").alias("tokens"))


COUNTERS = ("SELECT repo, count(*) AS total, count(*) FILTER (is_vulnerable) AS vulnerable, "
            "count(*) FILTER (NOT is_vulnerable) AS safe, count(*) FILTER (risk_level = 'HIGH') "
            "AS high_risk, greatest(count(DISTINCT doc_id), 1) AS files FROM verdict GROUP BY 1")
GRADE = ("CASE WHEN r = 0 THEN 'A+' WHEN r <= 10 THEN 'B' WHEN r <= 25 THEN 'C' WHEN r <= 40 "
         "THEN 'D' ELSE 'F' END")
RATED = "SELECT *, vulnerable / total::DOUBLE * 100 AS r FROM counters"


def _counters(spark, base):
    return detect.scan_counters(verdicts(spark, base), ["repo"], "doc_id")


@query("scan_counters", t.with_ctes((), "SELECT * FROM counters", **RULES, counters=COUNTERS))
def scan_counters(spark, base):
    return _counters(spark, base)


@query("security_grade", t.with_ctes(
    (), f"SELECT repo, total, vulnerable, round_even(r, 4) AS rate, {GRADE} AS grade FROM rated",
    **RULES, counters=COUNTERS, rated=RATED))
def security_grade(spark, base):
    return detect.with_grade(_counters(spark, base)).select(
        "repo", "total", "vulnerable", "rate", "grade")


@query("security_summary", t.with_ctes(
    (), f"SELECT repo, total, vulnerable, safe, high_risk, files, round_even(r, 4) AS rate, "
        f"{GRADE} AS grade, c.cwes, c.top_cwe FROM rated LEFT JOIN (SELECT repo AS rp, count(*) "
        "AS cwes, arg_max(cwe_category, n * 1000 - rank) AS top_cwe FROM (SELECT repo, "
        "cwe_category, count(*) AS n, min(rank) AS rank FROM verdict JOIN (SELECT cwe, min(rank) "
        "AS rank FROM rules GROUP BY 1) x ON x.cwe = cwe_category GROUP BY 1, 2) GROUP BY 1) c "
        "ON repo = rp",
    **WORDS, counters=COUNTERS, rated=RATED))
def security_summary(spark, base):
    """Per repository: counters, rate, grade and the most frequent weakness."""
    order = list(dict.fromkeys(r.cwe for r in t.WORD_RULES))
    found = verdicts(spark, base, t.WORD_RULES)
    return detect.with_grade(detect.scan_profile(found, ["repo"], "doc_id", order))


@query("cwe_distribution", t.with_ctes((), (
    "SELECT cwe_category, split_part(cwe_category, ':', 1) AS cwe_id, "
    "trim(split_part(cwe_category, ':', 2)) AS cwe_name, count(*) AS n, min(doc_id) AS "
    "first_seen FROM verdict WHERE is_vulnerable GROUP BY 1"), **RULES))
def cwe_distribution(spark, base):
    return detect.cwe_distribution(verdicts(spark, base), order="doc_id")


@query("safety_score", t.with_ctes((), (
    "SELECT lang, count(*) FILTER (NOT is_vulnerable) AS safe, count(*) AS total, "
    "floor(count(*) FILTER (NOT is_vulnerable) / count(*)::DOUBLE * 100)::INT AS score "
    "FROM verdict GROUP BY 1"), **RULES))
def safety_score(spark, base):
    counted = detect.scan_counters(verdicts(spark, base), ["language"], "doc_id")
    return counted.select(F.col("language").alias("lang"), "safe", "total",
                          scoring.safety_score(F.col("safe"), F.col("total")).alias("score"))


ADVICE = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in (cwe, advice[0], advice[3])) + ")"
    for cwe, advice in (*fixed.REMEDIATION.items(), ("", fixed.DEFAULT_REMEDIATION))
) + ") AS t(cwe_id, title, secure_example)"


@query("finding_remediation", t.with_ctes((), (
    "SELECT doc_id, cwe_category, coalesce(a.title, d.title) AS title, md5(coalesce("
    "a.secure_example, d.secure_example)) AS example_md5 FROM verdict v LEFT JOIN advice a ON "
    "a.cwe_id = split_part(cwe_category, ':', 1) JOIN advice d ON d.cwe_id = ''"),
    **WORDS, advice=ADVICE))
def finding_remediation(spark, base):
    found = detect.attach_remediation(verdicts(spark, base, t.WORD_RULES))
    return found.select("doc_id", "cwe_category", F.col("remediation.title").alias("title"),
                        F.md5("remediation.secure_example").alias("example_md5"))


def _quoted(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_LABELS = {c.split(":")[0]: (i, c) for i, c in enumerate(fixed.CWE_LABELS)}
DIMENSION = "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {_quoted(fixed.CWE_DIMENSION.get(c, (None,))[0])}, "
    f"{_LABELS[c][0] if c in _LABELS else 'NULL'})"
    for c in dict.fromkeys([*_LABELS, *fixed.CWE_DIMENSION])
) + ") AS t(cwe_id, severity, class_id)"


@query("cwe_dimension", t.with_ctes((), (
    "SELECT doc_id, split_part(cwe_category, ':', 1) AS cwe_id, severity, class_id::INT AS "
    "class_id FROM verdict v LEFT JOIN dim d ON d.cwe_id = split_part(cwe_category, ':', 1)"),
    **WORDS, dim=DIMENSION))
def cwe_dimension(spark, base):
    return detect.attach_cwe_dimension(verdicts(spark, base, t.WORD_RULES)).select(
        "doc_id", "cwe_id", "severity", "class_id")


@query("hybrid_verdict", t.with_ctes(("scores",), (
    "SELECT doc_id, flag AS is_vulnerable, round_even(c, 4) AS confidence, "
    "round_even(c * 100, 0)::INT AS confidence_percent, CASE WHEN flag AND cwe_category = 'N/A' "
    "THEN 'CWE-200: Information Exposure' ELSE cwe_category END AS cwe_category, "
    "CASE WHEN NOT flag THEN 'SAFE' WHEN prob >= 0.80 THEN 'HIGH' WHEN prob >= 0.60 THEN "
    "'MEDIUM' ELSE 'LOW' END AS risk_level FROM (SELECT *, CASE WHEN flag AND is_vulnerable "
    "THEN greatest(prob, 0.9139::DOUBLE) WHEN flag THEN prob ELSE 1::DOUBLE - prob END AS c "
    "FROM (SELECT v.*, coalesce(s.prob, 0::DOUBLE) AS prob, (coalesce(s.prob, 0::DOUBLE) >= 0.65 OR "
    "is_vulnerable) AS flag FROM verdict v LEFT JOIN scores s ON s.id = v.doc_id))"), **RULES))
def hybrid_verdict(spark, base):
    """All documents; one without a score is judged by the rules alone."""
    scored = detect.match_rules(t.source_files(spark, base)).join(
        t.scores(spark, base).withColumnRenamed("id", "doc_id"), "doc_id", "left").fillna(0.0, "prob")
    return detect.hybrid_verdict(scored).select(
        "doc_id", "is_vulnerable", "confidence", "confidence_percent", "cwe_category",
        "risk_level")


BANDED = ("SELECT id, prob, CASE WHEN prob < 0.5 THEN 'SAFE' WHEN prob >= 0.85 THEN 'HIGH' WHEN "
          "prob >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, round_even(prob * 100, 0)::INT "
          "AS confidence_percent FROM scores")


@query("risk_bands", t.with_ctes(("scores",), BANDED))
def risk_bands(spark, base):
    prob = F.col("prob")
    return t.scores(spark, base).select("id", "prob", scoring.risk_level(
        prob >= 0.5, prob).alias("risk_level"), scoring.percent(prob).alias("confidence_percent"))


@query("sigmoid_score", t.with_ctes(("scores",), "SELECT id, prob FROM scores"))
def sigmoid_score(spark, base):
    return t.scores(spark, base).select("id", "prob")


# Blocks and functions ----------------------------------------------------------------

INDENTED = "regexp_replace(text, '\\n([^AEIOU])', chr(10) || '    \\1', 'g')"


@query("segment_blocks", t.with_ctes((), (
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS block, "
    "pos::INT AS start_line, (coalesce(nxt, n + 1) - pos)::INT AS n_lines, line AS first, "
    "md5(array_to_string(ls[pos:coalesce(nxt, n + 1) - 1], chr(10))) AS block_md5 FROM ("
    "SELECT *, min(CASE WHEN regexp_matches(line, '^[^\\s]') THEN pos END) OVER (PARTITION BY "
    "doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, max(pos) "
    "OVER (PARTITION BY doc_id) AS n FROM lines) WHERE regexp_matches(line, '^[AEIOU]')"),
    texts=f"SELECT doc_id, {INDENTED} AS tx FROM documents",
    split="SELECT doc_id, string_split(CASE WHEN suffix(tx, chr(10)) THEN tx[:-2] ELSE tx END, "
          "chr(10)) AS ls FROM texts",
    lines="SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split"))
def segment_blocks(spark, base):
    files = t.source_files(spark, base).withColumn(
        "code", F.regexp_replace("code", r"\n([^AEIOU])", "\n    $1"))
    return extract.segment_blocks(files, "doc_id", "code", "^[AEIOU]").withColumn(
        "block_md5", F.md5("block_code")).drop("block_code")


# Code made of a text: five lines of code for each of its lines, by turns a function with an inner
# one, an asynchronous function with an inner one, and statements around a one-line function.
# {i} is the number of the line and {n} its length. Every seventh file doesn't parse.
CODE = ("def f{i}(a):\n    b = {n}\n    def g{i}(c):\n        return {n}\n    return b",
        "async def h{i}(a):\n    b = {n}\n    def k{i}(c):\n        return {n}\n    return b",
        "x{i} = {n}\ndef m{i}(): return {n}\n\nx{i} += 1\nprint(x{i})")
BROKEN = "\ndef ("


def _filled_sql(code):
    quoted = "'" + code.replace("\n", "' || chr(10) || '") + "'"
    return quoted.replace("{i}", "' || i || '").replace("{n}", "' || n || '")


def code_files(spark, base):
    def filled(code, line, i):
        size = F.length(line).cast("string")
        return F.replace(F.replace(F.lit(code), F.lit("{i}"), i.cast("string")), F.lit("{n}"), size)

    lines = F.transform(F.split("code", "\n"), lambda line, i: F.when(
        i % 3 == 0, filled(CODE[0], line, i)).when(i % 3 == 1, filled(CODE[1], line, i)).otherwise(
        filled(CODE[2], line, i)))
    broken = F.when(F.col("doc_id") % 7 == 3, BROKEN).otherwise("")
    return t.source_files(spark, base).withColumn("code", F.concat(F.array_join(lines, "\n"), broken))


@query("extract_functions", t.with_ctes((), (
    "SELECT doc_id::VARCHAR AS file_id, name, start_line::INT AS start_line, md5(code) AS md5 FROM ("
    f"SELECT doc_id, 'f' || i AS name, 5 * i + 1 AS start_line, {_filled_sql(CODE[0])} AS code FROM fine "
    "WHERE i % 3 = 0 UNION ALL SELECT doc_id, 'g' || i, 5 * i + 3, "
    + _filled_sql("    def g{i}(c):\n        return {n}") + " FROM fine WHERE i % 3 = 0 UNION ALL "
    "SELECT doc_id, 'k' || i, 5 * i + 3, " + _filled_sql("    def k{i}(c):\n        return {n}")
    + " FROM fine WHERE i % 3 = 1 UNION ALL SELECT doc_id, 'm' || i, 5 * i + 2, "
    + _filled_sql("def m{i}(): return {n}") + " FROM fine WHERE i % 3 = 2 UNION ALL "
    "SELECT doc_id, '<module_main>', 1, string_agg(CASE i % 3 WHEN 0 THEN "
    + _filled_sql(CODE[0]) + " WHEN 1 THEN " + _filled_sql(CODE[1]) + " ELSE " + _filled_sql(CODE[2])
    + " END, chr(10) ORDER BY i) || chr(10) || 'def (' FROM rows_ WHERE doc_id % 7 = 3 GROUP BY 1)"),
    pieces="SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents",
    rows_="SELECT doc_id, length(unnest(ls)) AS n, generate_subscripts(ls, 1) - 1 AS i FROM pieces",
    fine="SELECT * FROM rows_ WHERE doc_id % 7 <> 3"))
def extract_functions(spark, base):
    return extract.extract_functions(code_files(spark, base), "doc_id", "code").select(
        "file_id", "name", "start_line", F.md5("code").alias("md5"))


# Findings and reports ----------------------------------------------------------------

@query("findings_projection", t.with_ctes(("findings",), (
    "SELECT filename, function_name, start_line, is_vulnerable, risk_level, confidence_percent, "
    "cwe_category, array_to_string(suspicious_tokens, ',') AS suspicious_tokens FROM findings")))
def findings_projection(spark, base):
    return report.report_columns(t.findings(spark, base)).withColumn(
        "suspicious_tokens", F.array_join("suspicious_tokens", ","))


@query("anonymised_findings", t.with_ctes(("findings",), (
    "SELECT f.scan_id, f.ord, 'File ' || l.n AS filename, f.function_name, "
    "f.vulnerable_line_text, f.cwe_category FROM findings f JOIN labels_ l ON f.scan_id = "
    "l.scan_id AND f.filename = l.filename"),
    labels_="SELECT scan_id, filename, row_number() OVER (PARTITION BY scan_id ORDER BY "
            "min(ord)) AS n FROM findings GROUP BY 1, 2"))
def anonymised_findings(spark, base):
    return report.anonymise_findings(t.findings(spark, base), t.FINDING_CHUNK).select(
        "scan_id", "ord", "filename", "function_name", "vulnerable_line_text", "cwe_category")


@query("anonymised_targets", t.with_ctes(("scan_history",), (
    "SELECT id, 'Anonymized Target (' || files_scanned || ' file' || CASE WHEN files_scanned > 1 "
    "THEN 's' ELSE '' END || ')' AS filename FROM scan_history")))
def anonymised_targets(spark, base):
    return t.scan_history(spark, base).select(
        "id", report.target_name(F.col("files_scanned")).alias("filename"))


@query("enumerate_findings", t.with_ctes(("findings",), (
    "SELECT scan_id, ord, row_number() OVER (PARTITION BY scan_id ORDER BY ord) AS n "
    "FROM findings WHERE is_vulnerable")))
def enumerate_findings(spark, base):
    return number_rows(t.findings(spark, base).where("is_vulnerable").select("scan_id", "ord"),
                       ["scan_id"], "ord", "n", t.FINDING_CHUNK)


@query("report_lines", t.with_ctes(("scan_history", "findings"), (
    "SELECT scan_id, section, item, (generate_subscripts(ls, 1) - 1)::INT AS line_no, "
    "unnest(ls) AS line FROM parts"),
    bad="SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ord) AS n FROM findings "
        "WHERE is_vulnerable",
    parts="SELECT id AS scan_id, 0 AS section, 0::BIGINT AS item, ["
          f"'{report.REPORT_TITLE}', repeat('=', 40), 'File: ' || filename, 'Scan Time: ' || "
          "strftime(scan_time, '%Y-%m-%d %H:%M:%S'), 'Total Functions Analysed: ' || "
          "total_functions, 'Vulnerable Functions: ' || vulnerable_count, 'Safe Functions: ' || "
          "safe_count, ''] AS ls FROM scan_history "
          "UNION ALL SELECT id, 1, 0, ['VULNERABLE FUNCTIONS', repeat('-', 20)] FROM "
          "scan_history WHERE vulnerable_count > 0 "
          "UNION ALL SELECT scan_id, 1, n, ['[' || n || '] ' || function_name || ' -- Line ' || "
          "start_line, '    Risk Level: ' || risk_level, '    Confidence: ' || "
          "confidence_percent || '%', '    CWE Category: ' || cwe_category, "
          "'    Suspicious Tokens: ' || array_to_string(suspicious_tokens, ' | '), ''] FROM bad "
          "UNION ALL SELECT id, 2, -1, ['SAFE FUNCTIONS', repeat('-', 14)] FROM scan_history "
          "WHERE safe_count > 0 "
          "UNION ALL SELECT scan_id, 2, ord, [function_name || ' -- Line ' || start_line || "
          "' -- Confidence: ' || confidence_percent || '%'] FROM findings WHERE NOT "
          "is_vulnerable "
          "UNION ALL SELECT id, 3, 0, [''] FROM scan_history WHERE safe_count > 0 "
          f"UNION ALL SELECT id, 4, 0, ['{report.REPORT_FOOTER}'] FROM scan_history"))
def report_lines(spark, base):
    scans = (t.scan_history(spark, base).withColumnRenamed("id", "scan_id")
             .withColumn("scan_time", F.date_format("scan_time", t.TIME)))
    return report.report_lines(scans, t.findings(spark, base), t.FINDING_CHUNK)


SARIF_ID = "split_part(cwe_category, ':', 1)"


@query("sarif_rules", t.with_ctes(("findings",), (
    "SELECT scan_id, rule_id, row_number() OVER (PARTITION BY scan_id ORDER BY first) AS "
    "rule_index, trim(split_part(cwe, ':', 2)) AS name, 'Security Finding: ' || cwe AS "
    "short_description, md5(coalesce(a.secure_example, d.secure_example)) AS help_md5 FROM f "
    "LEFT JOIN advice a ON a.cwe_id = rule_id JOIN advice d ON d.cwe_id = ''"),
    advice=ADVICE,
    f=f"SELECT scan_id, {SARIF_ID} AS rule_id, min(cwe_category) AS cwe, min(ord) AS first FROM "
      "findings WHERE is_vulnerable GROUP BY 1, 2"))
def sarif_rules(spark, base):
    rules = report.sarif_rules(t.findings(spark, base))
    return rules.select("scan_id", "rule_id", "rule_index", "name", "short_description",
                        F.md5("help").alias("help_md5"))


@query("sarif_results", t.with_ctes(("findings",), (
    f"SELECT scan_id, ord, {SARIF_ID} AS rule_id, CASE WHEN risk_level = 'HIGH' THEN 'error' "
    "ELSE 'warning' END AS level, 'Vulnerability detected in ' || function_name || '(): ' || "
    "cwe_category || '. Suspicious tokens: ' || array_to_string(suspicious_tokens, ', ') AS "
    "message, filename AS uri, CASE WHEN vulnerable_line_no = 0 THEN start_line ELSE "
    "vulnerable_line_no END AS start_line FROM findings WHERE is_vulnerable")))
def sarif_results(spark, base):
    return report.sarif_results(t.findings(spark, base))


@query("json_roundtrip", t.with_ctes(("findings",), (
    "SELECT scan_id, (row_number() OVER (PARTITION BY scan_id ORDER BY ord) - 1)::INT AS ord, "
    "function_name, start_line, is_vulnerable, confidence, cwe_category, "
    "array_to_string(suspicious_tokens, ',') AS suspicious_tokens FROM findings WHERE scan_id "
    "IN (SELECT o_orderkey FROM orders)")))
def json_roundtrip(spark, base):
    """Findings into one JSON text per scan and back into rows."""
    scans = (t.scan_history(spark, base).withColumnRenamed("id", "scan_id")
             .withColumn("scan_time", F.date_format("scan_time", t.TIME)))
    stored = history.stored_scans(scans, t.findings(spark, base), complete=detect.attach_remediation)
    back = parse_stored_scan(stored.select(F.col("scan_id").alias("id"), "scan_result_json"), fields=(
        "function_name", "start_line", "is_vulnerable", "confidence", "cwe_category", "suspicious_tokens"))
    return back.select(F.col("scan_id"), F.col("ord").cast("int").alias("ord"), "function_name", "start_line", "is_vulnerable",
                       "confidence", "cwe_category",
                       F.array_join("suspicious_tokens", ",").alias("suspicious_tokens"))
