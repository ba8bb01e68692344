"""Report output: anonymised findings, text report lines, SARIF rows, JSON documents.

A document is produced as ordered lines, never as one collected value, so a scan of any
size can be written; the parts of `write.text` put together give the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import scoring
from .detect import REMEDIATION_FIELDS, attach_remediation
from .skew import number_rows, salted_join

REPORT_TITLE = "Vulnerability Detection Report"
REPORT_FOOTER = "End of report"
FINDING_COLUMNS = ("filename", "function_name", "start_line", "is_vulnerable", "risk_level",
                   "confidence_percent", "cwe_category", "suspicious_tokens")
SARIF_SCHEMA = ("https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/"
                "sarif-schema-2.1.0.json")


def report_columns(findings: DataFrame, default_file: Column | None = None) -> DataFrame:
    name = F.col("filename") if default_file is None else F.coalesce("filename", default_file)
    return findings.withColumn("filename", name).select(*FINDING_COLUMNS)


def file_labels(firsts: DataFrame, chunk: int, scan: str = "scan_id", file: str = "filename"
                ) -> DataFrame:
    """`File n` per scan and file, numbered by first appearance."""
    numbered = number_rows(firsts, [scan], "first_ord", "_n", chunk)
    return numbered.select(scan, file, F.concat(F.lit("File "), "_n").alias("file_label"),
                           "n_rows")


def target_name(n_files: Column) -> Column:
    return F.concat(F.lit("Anonymized Target ("), n_files.cast("string"), F.lit(" file"),
                    F.when(n_files > 1, "s").otherwise(""), F.lit(")"))


def anonymise_findings(findings: DataFrame, chunk: int = 1_000_000, scan: str = "scan_id",
                       ord: str = "ord", redact_lines: bool = False) -> DataFrame:
    """Replace file names by labels and leave the code out."""
    firsts = findings.groupBy(scan, "filename").agg(F.min(ord).alias("first_ord"),
                                                    F.count("*").alias("n_rows"))
    labels = file_labels(firsts, chunk, scan)
    out = (salted_join(findings, labels, [scan, "filename"], "left", [ord], "n_rows", firsts)
           .drop("filename", "function_code").withColumnRenamed("file_label", "filename"))
    if redact_lines:
        out = out.withColumn("vulnerable_line_text", F.lit(""))
    return out


def with_stored_defaults(findings: DataFrame) -> DataFrame:
    """Fill what a stored finding needs where it is absent or null."""
    advice = F.struct(*[F.lit(v).alias(f) for f, v in
                        zip(REMEDIATION_FIELDS, fixed.STORED_REMEDIATION, strict=True)])
    defaults = {
        "function_name": F.lit("unknown"), "start_line": F.lit(0),
        "vulnerable_line_no": F.col("start_line"), "vulnerable_line_text": F.lit(""),
        "is_vulnerable": F.lit(False), "confidence": F.lit(0.0), "confidence_percent": F.lit(0),
        "cwe_category": F.lit(fixed.NO_CWE), "suspicious_tokens": F.array().cast("array<string>"),
        "risk_level": F.lit("SAFE"), "remediation": advice, "filename": F.lit(""),
    }
    for name, value in defaults.items():
        known = name in findings.columns
        findings = findings.withColumn(name, F.coalesce(F.col(name), value) if known else value)
    return findings


def report_lines(scans: DataFrame, findings: DataFrame, chunk: int = 1_000_000,
                 title: str = REPORT_TITLE, footer: str = REPORT_FOOTER) -> DataFrame:
    """Text report as rows (scan_id, section, item, line_no, line) in that order.

    `scans` holds the counters; a section without findings has no heading.
    """
    def lines(section: int, item: Column, texts: list[Column]) -> Column:
        return F.transform(F.array(*texts), lambda line, i: F.struct(
            F.lit(section).alias("section"), item.cast("bigint").alias("item"),
            i.alias("line_no"), line.alias("line")))

    def text(label: str, column: str) -> Column:
        return F.concat(F.lit(label), F.col(column).cast("string"))

    def when(condition: str, part: Column) -> Column:
        return F.when(F.expr(condition), part).otherwise(F.slice(part, 1, 0))

    zero = F.lit(0)
    frame = F.concat(
        lines(0, zero, [
            F.lit(title), F.lit("=" * 40), text("File: ", "filename"),
            text("Scan Time: ", "scan_time"),
            text("Total Functions Analysed: ", "total_functions"),
            text("Vulnerable Functions: ", "vulnerable_count"),
            text("Safe Functions: ", "safe_count"), F.lit("")]),
        when("vulnerable_count > 0", lines(1, zero, [F.lit("VULNERABLE FUNCTIONS"),
                                                     F.lit("-" * 20)])),
        when("safe_count > 0", lines(2, F.lit(-1), [F.lit("SAFE FUNCTIONS"), F.lit("-" * 14)])),
        when("safe_count > 0", lines(3, zero, [F.lit("")])),
        lines(4, zero, [F.lit(footer)]))
    flagged = number_rows(findings.where("is_vulnerable"), ["scan_id"], "ord", "_n", chunk)
    bad = lines(1, F.col("_n"), [
        F.concat(F.lit("["), F.col("_n"), F.lit("] "), "function_name", F.lit(" -- Line "),
                 F.col("start_line")),
        text("    Risk Level: ", "risk_level"),
        F.concat(F.lit("    Confidence: "), F.col("confidence_percent"), F.lit("%")),
        text("    CWE Category: ", "cwe_category"),
        F.concat(F.lit("    Suspicious Tokens: "),
                 F.array_join("suspicious_tokens", " | ")), F.lit("")])
    good = lines(2, F.col("ord"), [
        F.concat("function_name", F.lit(" -- Line "), F.col("start_line"),
                 F.lit(" -- Confidence: "), F.col("confidence_percent"), F.lit("%"))])
    return (scans.select("scan_id", F.inline(frame))
            .unionByName(flagged.select("scan_id", F.inline(bad)))
            .unionByName(findings.where("not is_vulnerable").select("scan_id", F.inline(good))))


def _rule_id(category: Column) -> Column:
    return F.when(F.contains(category, F.lit(":")), F.trim(scoring.cwe_id(category))
                  ).otherwise(fixed.OTHER_CATEGORY)


def sarif_rules(findings: DataFrame, tool: str = "Security") -> DataFrame:
    """Distinct rules per scan, in order of first appearance."""
    category = F.col("cwe_category")
    first = (findings.where("is_vulnerable").withColumn("rule_id", _rule_id(category))
             .groupBy("scan_id", "rule_id")
             .agg(F.min_by("cwe_category", "ord").alias("cwe_category"),
                  F.min("ord").alias("_first")))
    # One row per scan and rule of the rule table: the advice is looked up here, not per finding.
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy("_first"))
    return attach_remediation(first).select(
        "scan_id", "rule_id", place.alias("rule_index"),
        scoring.cwe_name(category).alias("name"),
        F.concat(F.lit(f"{tool} Finding: "), category).alias("short_description"),
        F.col("remediation.description").alias("full_description"),
        F.col("remediation.secure_example").alias("help"))


def sarif_results(findings: DataFrame) -> DataFrame:
    category = F.col("cwe_category")
    message = F.concat(F.lit("Vulnerability detected in "), F.col("function_name"),
                       F.lit("(): "), category, F.lit(". Suspicious tokens: "),
                       F.array_join("suspicious_tokens", ", "))
    return findings.where("is_vulnerable").select(
        "scan_id", "ord", _rule_id(category).alias("rule_id"),
        F.when(F.col("risk_level") == "HIGH", "error").otherwise("warning").alias("level"),
        message.alias("message"), F.coalesce("filename", F.lit("target.py")).alias("uri"),
        F.coalesce(F.nullif(F.col("vulnerable_line_no"), F.lit(0)), F.col("start_line"),
                   F.lit(1)).alias("start_line"))


def sarif_lines(findings: DataFrame, tool: str = "Security", version: str = "2.0.0"
                ) -> DataFrame:
    """SARIF 2.1.0 documents as ordered lines (scan_id, section, item, line)."""
    rules = sarif_rules(findings, tool)
    results = sarif_results(findings)
    scans = findings.select("scan_id").distinct()
    first = results.groupBy("scan_id").agg(F.min("ord").alias("_lead"),
                                           F.count("*").alias("n_rows"))

    def comma(leading: Column) -> Column:
        return F.when(leading, "").otherwise(",")

    def row(df: DataFrame, section: int, item: Column, line: Column) -> DataFrame:
        return df.select("scan_id", F.lit(section).alias("section"),
                         item.cast("bigint").alias("item"), line.alias("line"))

    def nest(name: str, value: Column) -> Column:
        return F.struct(value.alias("text")).alias(name)

    head = F.lit('{"$schema":"%s","version":"2.1.0","runs":[{"tool":{"driver":{"name":"%s '
                 'scanner","semanticVersion":"%s","rules":[' % (SARIF_SCHEMA, tool, version))
    rule = F.to_json(F.struct(
        F.col("rule_id").alias("id"), "name", nest("shortDescription", F.col("short_description")),
        nest("fullDescription", F.col("full_description")), nest("help", F.col("help"))))
    place = F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(
        F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level",
                                nest("message", F.col("message")),
                                F.array(place).alias("locations")))
    led = salted_join(results, first, ["scan_id"], "left", ["ord"], "n_rows")
    return (row(scans, 0, F.lit(0), head)
            .unionByName(row(rules, 1, F.col("rule_index"),
                             F.concat(comma(F.col("rule_index") == 1), rule)))
            .unionByName(row(scans, 2, F.lit(0), F.lit(']}},"results":[')))
            .unionByName(row(led, 3, F.col("ord"),
                             F.concat(comma(F.col("ord") == F.col("_lead")), result)))
            .unionByName(row(scans, 4, F.lit(0), F.lit("]}]}"))))


def cli_report_lines(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON report as ordered lines: totals, then the findings array."""
    body = findings.select("ord", F.to_json(F.struct(*FINDING_COLUMNS)).alias("_j"))
    lead = findings.agg(F.min("ord").alias("ord"))
    head = F.to_json(F.struct("target", "security_grade", "total_functions",
                              "vulnerable_functions", "execution_time_seconds"))
    opened = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"findings":['))
    marked = body.join(F.broadcast(lead.withColumn("_leads", F.lit(True))), "ord", "left")
    listed = marked.select(
        F.lit(1).alias("section"), F.col("ord").cast("bigint").alias("item"),
        F.concat(F.when(F.col("_leads"), "").otherwise(","), "_j").alias("line"))
    one = F.lit(0).cast("bigint").alias("item")
    return (summary.select(F.lit(0).alias("section"), one, opened.alias("line"))
            .unionByName(listed)
            .unionByName(summary.select(F.lit(2).alias("section"), one,
                                        F.lit("]}").alias("line"))))
