"""End-to-end jobs composed of the operators."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import Rule
from ..functions import lexing, text
from ..operators import curate, detect, extract, model, report, skew
from ..session import settle
from ..sources import changes, corpus, history, sinks, tree


def preprocess_files(files: DataFrame, vocabulary: DataFrame | None = None,
                     exact: bool = False) -> DataFrame:
    """(path, content) to functions: filename, function_name, code, start_line, raw_tokens,
    and with a `vocabulary` the encoded `tokens`."""
    functions = extract.extract_functions(tree.with_code(files), "path", "code")
    named = functions.withColumnsRenamed({"file_id": "filename", "name": "function_name"})
    raw = lexing.lex_shown_tokens("code") if exact else text.display_tokens(F.col("code"))
    out = named.withColumn("raw_tokens", raw)
    if vocabulary is None:
        return out
    words = lexing.lex_scorer_tokens("code") if exact else text.scan_tokens(F.col("code"))
    return curate.encode_tokens(out.withColumn("words", words), vocabulary, ["filename", "fn"], "words").drop(
        "words").withColumnRenamed("features", "tokens")


def scan_files(files: DataFrame, rules: Sequence[Rule] = fixed.DEFAULT_RULES,
               exact_tokens: bool = False) -> DataFrame:
    """(path, content) to findings, one row per function."""
    found = detect.detect(preprocess_files(files, exact=exact_tokens), "code", rules,
                          F.col("start_line"), "raw_tokens")
    return found.withColumnRenamed("code", "function_code").drop(
        "matched_tokens", "rule_category")


def scan_hybrid(files: DataFrame, scorer, threshold: float = fixed.DEFAULT_THRESHOLD,
                rules: Sequence[Rule] = fixed.DEFAULT_RULES, exact_tokens: bool = False) -> DataFrame:
    """(path, content) to findings of the combined detector, one row per function.

    The functions are written down once; the scorer rates their tokens, its heaviest tokens
    are shown, and the rules are matched on the same rows.
    """
    code = text.normalise_code(F.col("code"), F.lit("py"))
    tokenise = lexing.lex_model_tokens if exact_tokens else text.corpus_tokens
    tokens = skew.compute_once(preprocess_files(files, exact=exact_tokens), tokens=tokenise(code))
    functions = skew.number_all(tokens, ["filename", "fn"], "ord", "functions")
    weights = model.token_weights(functions, model.token_table(scorer, functions), "ord", count="n")
    scored = model.score_batch(scorer, functions).join(weights, "ord", "left")
    found = detect.score_hybrid(scored, weights="token_weights", threshold=threshold, rules=rules,
                                start_line=F.col("start_line"))
    return found.withColumnRenamed("code", "function_code").drop(
        "matched_tokens", "rule_category", "tokens", "token_weights", "prob", "ord")


def scan_summary(findings: DataFrame, target: str) -> DataFrame:
    """One row of totals and the grade."""
    counted = detect.with_grade(detect.scan_counters(findings, [], "filename"))
    grade = F.when(F.col("total") > 0, F.col("grade"))
    return counted.select(F.lit(target).alias("target"), grade.alias("security_grade"),
                          F.col("total").alias("total_functions"),
                          F.col("vulnerable").alias("vulnerable_functions"),
                          F.col("safe").alias("safe_functions"), "high_risk", "files", "rate")


def scan_corpus(spark: SparkSession, root: str, output: str | None = None,
                rules: Sequence[Rule] = fixed.DEFAULT_RULES, scorer=None,
                threshold: float = fixed.DEFAULT_THRESHOLD) -> dict[str, DataFrame]:
    """Scan a source tree or one file, by rules alone or with a `scorer` as well.

    With `output` findings and summary are written as JSON rows, and one report document as
    lines. A missing path is an error. Where no function was found the summary has no grade.
    """
    began = time.monotonic()
    files = tree.read_source_tree(spark, root)
    found = scan_files(files, rules) if scorer is None else scan_hybrid(files, scorer, threshold, rules)
    findings = skew.number_all(found, ["filename", "fn"], "ord", "findings")
    seconds = F.lit(round(time.monotonic() - began, 2)).alias("execution_time_seconds")
    out = {"findings": findings, "summary": scan_summary(findings, root),
           "distribution": detect.cwe_distribution(findings)}
    if output:
        sinks.write_json(report.report_columns(findings), f"{output}/findings")
        sinks.write_json(out["summary"], f"{output}/summary")
        sinks.write_lines(report.cli_report_lines(out["summary"].select("*", seconds), findings),
                          f"{output}/report", ["section", "item"])
    return out


def scan_changes(spark: SparkSession, root: str, state: str, output: str,
                 rules: Sequence[Rule] = fixed.DEFAULT_RULES, buckets: int = 64) -> dict[str, int]:
    """Scan the files of a tree that are new or changed since the last call; counts of what was done.

    `state` is a versioned table of path, stamp, digest and the version that scanned the file; its
    next version is put in place after the findings were written to `output/scan=<version>`. A run
    that fails before is repeated in full and writes to the same place; afterwards nothing is
    scanned twice. A renamed file is new under its name, and one written with the same bytes is
    not scanned again. `current_findings` gives the whole tree. One caller at a time.
    """
    seen = changes.open_seen(spark, state, buckets)
    changed, touched, gone = changes.find_changes(spark, root, seen)
    version = seen.version + 1
    counts = {"changed": changed.count(), "touched": touched.count(), "gone": gone.count()}
    if not any(counts.values()):
        return counts
    if counts["changed"]:
        scan_files(changed.select("path", "content"), rules).write.mode("overwrite").parquet(
            f"{output}/scan={version}")
    rows = changed.select("path", "stamp", "digest", F.lit(version).alias("scanned")).unionByName(touched)
    seen.upsert(rows.withColumn("_deleted", F.lit(False)).unionByName(
        gone.withColumn("_deleted", F.lit(True)), allowMissingColumns=True))
    return counts


def current_findings(spark: SparkSession, state: str, output: str) -> DataFrame:
    """Findings of the tree as last scanned: of each file those of its latest scan, `scan` naming it."""
    seen = changes.VersionedTable.open(spark, state).read()
    return spark.read.option("basePath", output).parquet(f"{output}/scan=*").join(
        seen.select(F.col("path").alias("filename"), F.col("scanned").alias("scan")), ["filename", "scan"], "left_semi")


def record_scan(findings: DataFrame, scan_id: int, user_id: int, target: str, base: str,
                address: str | None = None) -> None:
    """Store a finished scan anonymised, and log it.

    Findings are written down once, numbered by file name and place in the file, so that files
    are read and parsed a single time. The log names the target; the stored scan does not.
    """
    placed = (skew.number_all(findings, ["filename", "fn"], "ord", "scan-findings")
              .withColumn("scan_id", F.lit(scan_id)).drop("fn"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    scans = settle(detect.scan_counters(placed, ["scan_id"], "filename").select(
        "scan_id", F.lit(user_id).alias("user_id"), now.alias("scan_time"),
        F.col("total").alias("total_functions"), F.col("vulnerable").alias("vulnerable_count"),
        F.col("safe").alias("safe_count"), F.col("high_risk").alias("high_risk_count"),
        F.col("files").alias("files_scanned")), "scan")
    history.append_scans(scans, placed, base)
    details = F.concat(F.lit(f"Target: {target} ("), F.col("files_scanned"),
                       F.lit(" files), Vulnerable: "), F.col("vulnerable_count"))
    history.append_audit(scans.select(
        F.col("scan_id").alias("id"), "user_id", F.lit("SCAN_COMPLETED").alias("action"),
        F.lit(address).cast("string").alias("ip_address"),
        F.col("scan_time").cast("timestamp").alias("timestamp"), details.alias("details")), base)


def load_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A labelled CSV with its row numbers written down once, so that they never change."""
    return settle(corpus.read_labelled_corpus(spark, path), "labelled")


def curated(labelled: DataFrame, language: str | None = "py", exact: bool = False
            ) -> DataFrame:
    """Labelled rows to clean, conflict-free, distinct, normalised, tokenised rows."""
    return _normalised(curate.resolve_copies(curate.clean_labelled(labelled)), language, exact)


def _normalised(clean: DataFrame, language: str | None, exact: bool = False) -> DataFrame:
    tokenise = lexing.lex_model_tokens if exact else text.corpus_tokens
    return curate.normalise(curate.language_slice(clean, language), tokenise=tokenise)


def curate_corpus(labelled: DataFrame, output: str, language: str | None = "py",
                  max_vocabulary: int = 10_000, fit_on: str = "all", exact: bool = False
                  ) -> DataFrame:
    """Curate, split, encode and write; returns the summary per split.

    `fit_on="train"` builds the vocabulary on the training rows only.
    """
    clean = settle(curate.resolve_copies(curate.clean_labelled(labelled)), "clean")
    sinks.write_corpus_csv(clean, f"{output}/clean", sinks.CLEAN_COLUMNS)
    table = settle(_normalised(clean, language, exact), "curated")
    return _finish(table, output, max_vocabulary, fit_on, sinks.NORMALISED_COLUMNS, language,
                   raw_rows=labelled, raw_samples=clean)


def _finish(table: DataFrame, output: str, max_vocabulary: int, fit_on: str,
            columns: Sequence[str], language: str | None, categories: str | None = None,
            **counted: DataFrame) -> DataFrame:
    split = settle(curate.stratified_split(table, "ord"), "split")
    base = split.where("split = 'train'") if fit_on == "train" else split
    vocabulary = settle(curate.build_vocabulary(base, "tokens", max_vocabulary), "vocabulary")
    encoded = curate.encode_tokens(split, vocabulary, "ord")
    sinks.write_corpus_csv(split, f"{output}/normalised", columns)
    sinks.write_corpus_csv(split, f"{output}/splits", [*sinks.SPLIT_COLUMNS, "split"])
    sinks.write_splits(encoded, [f"{output}/encoded"])
    sinks.write_vocabulary(vocabulary, f"{output}/vocabulary", as_json=True)
    summary = curate.dataset_summary(split)
    shares = curate.value_counts(split, categories) if categories else None
    sinks.write_json(curate.summary_document(
        summary, language, categories=shares, vocabulary_size=vocabulary, **counted),
        f"{output}/summary")
    return summary


def diff_snippets(docs: DataFrame) -> DataFrame:
    """Nested diff documents to curated snippets with weakness and category."""
    parts = detect.attach_category(curate.diff_sides(corpus.diff_parts(docs)))
    category = F.array_position(F.array(*[F.lit(c) for c in fixed.DIFF_CATEGORIES]),
                                F.col("source_category"))
    place = [F.lpad(p.cast("string"), 10, "0") for p in (category, *(
        F.col(f"{n}_pos") for n in ("repo", "commit", "file", "change", "side", "part")))]
    ordered = parts.withColumn("ord", F.concat(*place))
    clean = curate.clean_labelled(ordered.withColumn("language", F.lit("py")))
    return curate.normalise(curate.resolve_copies(clean))


def curate_diff_corpus(docs: DataFrame, labelled: DataFrame, output: str,
                       max_vocabulary: int = 15_000, drop_conflicts: bool = False
                       ) -> DataFrame:
    """Diff snippets first, labelled corpus second, merged, split, encoded and written."""
    snippets = settle(diff_snippets(docs), "snippets")
    sinks.write_corpus_csv(snippets, f"{output}/snippets", [*sinks.SPLIT_COLUMNS, "cwe"])
    other = (curated(labelled).withColumn("cwe", F.lit("Unspecified-Vulnerability"))
             .withColumn("source_category", F.lit("labelled")))
    merged = settle(curate.union_corpora([snippets, other],
                                         drop_conflicts=drop_conflicts), "merged")
    return _finish(merged, output, max_vocabulary, "all", sinks.COMBINED_COLUMNS, "py", "cwe",
                   snippets=snippets, combined_samples=merged)


def train_and_evaluate(split: DataFrame, output: str | None = None, corpus_name: str = "corpus",
                       model_name: str = "linear", **options) -> tuple[object, DataFrame]:
    """Train on `train`, keep the best round and pick the threshold on `val`, measure on `test`.

    With `output`: `epochs` (a row per round), `training_report` (threshold, test ratios, seconds of training) and
    `metrics` (corpus, model, counts and ratios, for `read_metrics`) are written below it.
    """
    parts = {name: split.where(F.col("split") == name) for name in ("train", "val", "test")}
    started = time.monotonic()
    scorer = model.train_classifier(parts["train"], parts["val"], **options)
    seconds = time.monotonic() - started
    val = settle(model.score_batch(scorer, parts["val"]).select("prob", "label"), "scores")
    cut = model.calibrate(val).first()["threshold"]
    test = settle(model.score_batch(scorer, parts["test"]).select("prob", "label"), "scores")
    metrics = model.evaluate_scores(test, cut).withColumn("calibrated_threshold", F.lit(cut))
    if output is not None:
        scorer.epoch_table(split.sparkSession).write.mode("overwrite").parquet(f"{output}/epochs")
        measured = settle(metrics, "metrics")
        sinks.write_json(measured.select(
            "calibrated_threshold", *[F.col(c).alias(f"test_{c}") for c in ("accuracy", "precision", "recall", "f1", "auc")],
            F.lit(seconds).alias("training_time_seconds")), f"{output}/training_report")
        sinks.write_metrics(measured, f"{output}/metrics", corpus_name, model_name)
    return scorer, metrics
