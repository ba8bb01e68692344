"""Rule matching, verdicts, line location and scan summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import Rule
from ..functions import scoring, text
from .skew import compute_once

_SEP = "\x01"
REMEDIATION_FIELDS = ("title", "description", "vulnerable_example", "secure_example")


def match_rules(df: DataFrame, code: str = "code",
                rules: Sequence[Rule] = fixed.DEFAULT_RULES,
                tokens: str | None = None) -> DataFrame:
    """Add `matched_tokens` (rule order) and `rule_category` (first match wins).

    The rule table is compiled into one expression per rule over the lowered text, so there
    is no join and no row is repeated. With `tokens` a rule also matches on an exact token.
    """
    lowered = df.withColumn("_low", F.lower(F.col(code)))
    if tokens is not None:
        lowered = lowered.withColumn("_tok", F.transform(tokens, lambda t: F.lower(t)))

    def hit(rule: Rule) -> Column:
        cond = text.contains_word(F.col("_low"), rule.token)
        if tokens is not None:
            cond = F.array_contains("_tok", rule.token.lower()) | cond
        return F.when(cond, F.lit(rule.token))

    category = F.create_map(*[F.lit(x) for r in rules for x in (r.token, r.cwe)])
    joined = compute_once(lowered, _hits=F.concat_ws(_SEP, *[hit(r) for r in rules]))
    matched = F.when(F.col("_hits") == "", F.array().cast("array<string>")).otherwise(
        F.split("_hits", _SEP))
    first = F.nullif(F.substring_index("_hits", _SEP, 1), F.lit(""))
    return (joined
            .withColumn("matched_tokens", matched)
            .withColumn("rule_category",
                        F.coalesce(F.try_element_at(category, first), F.lit(fixed.NO_CWE)))
            .drop("_low", "_hits", "_tok"))


def rule_verdict(df: DataFrame) -> DataFrame:
    """Verdict of the rule detector from `matched_tokens`."""
    flagged = F.size("matched_tokens") > 0
    return df.withColumns({
        "is_vulnerable": flagged,
        "confidence": F.when(flagged, fixed.RULE_CONFIDENCE).otherwise(fixed.SAFE_CONFIDENCE),
        "confidence_percent": F.when(flagged, fixed.RULE_CONFIDENCE_PERCENT)
        .otherwise(fixed.SAFE_CONFIDENCE_PERCENT),
        "cwe_category": F.col("rule_category"),
        "risk_level": scoring.risk_level(flagged, F.lit(fixed.RULE_CONFIDENCE)),
        "suspicious_tokens": F.slice(F.array_distinct("matched_tokens"), 1, 5),
    })


def hybrid_verdict(df: DataFrame, prob: str = "prob",
                   threshold: Column | float = fixed.DEFAULT_THRESHOLD) -> DataFrame:
    """Combine a scorer's probability with the rule hits."""
    p, hit = F.col(prob), F.size("matched_tokens") > 0
    flag = df.withColumn("is_vulnerable", scoring.hybrid_flag(p, hit, threshold))
    confidence = scoring.hybrid_confidence(p, hit, F.col("is_vulnerable"))
    return flag.withColumns({
        # Half to even of the double itself: its shortest decimal form may be a tie where the double is none.
        "confidence": F.rint(confidence * 10_000) / 10_000,
        "confidence_percent": scoring.percent(confidence),
        "cwe_category": scoring.hybrid_category(F.col("is_vulnerable"), F.col("rule_category")),
        "risk_level": scoring.risk_level(F.col("is_vulnerable"), p, fixed.SCORE_BANDS),
    })


def top_tokens(ranked: Column, raw: Column, limit: int = 5, enough: int = 3) -> Column:
    """First distinct tokens; topped up with raw tokens when fewer than `enough`."""
    lead = F.slice(F.array_distinct(ranked), 1, limit)
    filled = F.array_distinct(F.concat(lead, F.filter(raw, lambda t: F.length(t) > 2)))
    return F.when(F.size(lead) < enough, F.slice(filled, 1, limit)).otherwise(lead)


def ranked_tokens(weights: Column, limit: int = 5) -> Column:
    """Tokens of `array<struct<token,weight,pos>>` by weight: long, distinct, no markers.

    The heaviest entries, ties included, mostly hold enough such tokens; only else all entries are ranked.
    """
    markers = fixed.RESERVED_TOKENS[2:]

    def ranked(entries: Column) -> Column:
        kept = F.filter(entries, lambda s: (F.length(s["token"]) > 2) & ~s["token"].isin(*markers))
        order = F.sort_array(F.transform(kept, lambda s: F.struct(s["weight"], s["pos"], s["token"])),
                             asc=False)
        return F.slice(F.array_distinct(F.transform(order, lambda s: s["token"])), 1, limit)

    least = F.get(F.sort_array(weights["weight"], asc=False), F.lit(4 * limit - 1))
    # Arrays of one: the threshold and the short ranking are worked out once.
    heaviest = F.get(F.transform(F.array(least), lambda w: F.when(
        w.isNotNull(), F.filter(weights, lambda s: s["weight"] >= w))), F.lit(0))
    return F.get(F.transform(F.array(ranked(heaviest)), lambda short: F.when(
        F.size(short) >= limit, short).otherwise(ranked(weights))), F.lit(0))


def locate_line(df: DataFrame, code: str = "code", start_line: Column | None = None
                ) -> DataFrame:
    """First line that holds a suspicious token; the first line when none does.

    Lines are searched one by one, so a token with a line break hits none and is left out.
    The earliest hit of the others in the whole text lies on the first such line: one search
    per token replaces a pass over all lines.
    """
    start = F.lit(1) if start_line is None else start_line
    low = F.lower(F.col(code))
    usable = F.filter("suspicious_tokens",
                      lambda t: (F.length(t) > 2) & ~t.isin(*fixed.PLACEHOLDER_NAMES)
                      & ~t.rlike(text.LINE_BREAK))
    places = F.filter(F.transform(usable, lambda t: F.position(F.lower(t), F.col("_low"))),
                      lambda p: p > 0)
    before = F.substring(F.col("_low"), F.lit(1), F.col("_at") - 1)
    flagged = F.col("is_vulnerable") & (F.col(code) != "")
    lines = text.splitlines(F.col(code))
    return (df.withColumn("_low", low)
            .withColumn("_at", F.when(flagged, F.array_min(places)))
            .withColumn("_line", F.when(F.col("_at").isNotNull(),
                                        F.size(F.split(before, text.LINE_BREAK)) - 1)
                        .otherwise(0))
            .withColumn("vulnerable_line_no", (start + F.col("_line")).cast("int"))
            .withColumn("vulnerable_line_text", F.when(
                flagged, text.strip(F.coalesce(F.get(lines, F.col("_line")), F.lit(""))))
                .otherwise(""))
            .drop("_low", "_at", "_line"))


def remediation_table(spark: SparkSession) -> DataFrame:
    rows = [(cwe, *texts) for cwe, texts in fixed.REMEDIATION.items()]
    return spark.createDataFrame(
        rows, "cwe_id string, " + ", ".join(f"{f} string" for f in REMEDIATION_FIELDS))


def attach_remediation(df: DataFrame, category: str = "cwe_category", inside: str | None = None) -> DataFrame:
    """Add a `remediation` struct; the dimension has seven rows and is broadcast.

    With `inside`, it is added to each of the findings in that list column, and the dimension is a fixed map.
    """
    default = F.struct(*[F.lit(v).alias(f) for f, v in
                         zip(REMEDIATION_FIELDS, fixed.DEFAULT_REMEDIATION)])
    if inside is not None:
        advice = F.create_map(*[x for cwe, texts in fixed.REMEDIATION.items() for x in (F.lit(cwe), F.struct(*[
            F.lit(v).alias(f) for f, v in zip(REMEDIATION_FIELDS, texts)]))])
        return df.withColumn(inside, F.transform(inside, lambda x: x.withField("remediation", F.coalesce(
            F.try_element_at(advice, scoring.cwe_id(x[category])), default))))
    dim = remediation_table(df.sparkSession).select(
        F.col("cwe_id").alias("_cwe"), F.struct(*REMEDIATION_FIELDS).alias("_advice"))
    keyed = df.withColumn("_cwe", scoring.cwe_id(F.col(category)))
    return (keyed.join(F.broadcast(dim), "_cwe", "left")
            .withColumn("remediation", F.coalesce("_advice", default))
            .drop("_cwe", "_advice"))


def attach_category(df: DataFrame, category: str = "source_category") -> DataFrame:
    """Weakness of a diff category (seven fixed rows)."""
    table = F.create_map(*[F.lit(x) for kv in fixed.DIFF_CATEGORIES.items() for x in kv])
    return df.withColumn("cwe", F.coalesce(F.try_element_at(table, F.col(category)),
                                           F.lit(fixed.OTHER_CATEGORY)))


def cwe_dimension(spark: SparkSession) -> DataFrame:
    """One row per known weakness: severity, description, class label."""
    labels = {c.split(":")[0]: (i, c) for i, c in enumerate(fixed.CWE_LABELS)}
    ids = list(dict.fromkeys([*labels, *fixed.CWE_DIMENSION, *fixed.REMEDIATION]))
    rows = [(c, *fixed.CWE_DIMENSION.get(c, (None, None)), *labels.get(c, (None, None)))
            for c in ids]
    return spark.createDataFrame(
        rows, "cwe_id string, severity string, description string, class_id int, "
              "class_name string")


def attach_cwe_dimension(df: DataFrame, category: str = "cwe_category") -> DataFrame:
    keyed = df.withColumn("cwe_id", scoring.cwe_id(F.col(category)))
    return keyed.join(F.broadcast(cwe_dimension(df.sparkSession)), "cwe_id", "left")


def detect(df: DataFrame, code: str = "code", rules: Sequence[Rule] = fixed.DEFAULT_RULES,
           start_line: Column | None = None, tokens: str | None = None) -> DataFrame:
    """The rule detector, end to end: match, verdict, line, advice."""
    matched = rule_verdict(match_rules(df, code, rules, tokens))
    return attach_remediation(locate_line(matched, code, start_line))


def score_hybrid(df: DataFrame, prob: str = "prob", code: str = "code",
                 raw_tokens: str = "raw_tokens", weights: str | None = None,
                 threshold: Column | float = fixed.DEFAULT_THRESHOLD,
                 rules: Sequence[Rule] = fixed.DEFAULT_RULES, start_line: Column | None = None
                 ) -> DataFrame:
    """Scorer and rules, end to end: `prob` and optionally token `weights` are given.

    A flagged row shows its heaviest tokens; with fewer than three of them, and for safe
    rows, the row's first tokens are added.
    """
    judged = hybrid_verdict(match_rules(df, code, rules, raw_tokens), prob, threshold)
    none = F.array().cast("array<string>")
    heavy = none if weights is None else F.when(
        F.col("is_vulnerable"), ranked_tokens(F.col(weights))).otherwise(none)
    shown = judged.withColumn("suspicious_tokens", top_tokens(heavy, F.col(raw_tokens)))
    return attach_remediation(locate_line(shown, code, start_line))


# Summaries ---------------------------------------------------------------------------

def scan_counters(findings: DataFrame, keys: Sequence[str], file: str) -> DataFrame:
    return findings.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if("is_vulnerable").alias("vulnerable"),
        F.count_if(~F.col("is_vulnerable")).alias("safe"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk"),
        F.greatest(F.count_distinct(file), F.lit(1)).alias("files"))


def scan_profile(findings: DataFrame, keys: Sequence[str], file: str,
                 categories: Sequence[str]) -> DataFrame:
    """`scan_counters` plus the number of categories found and the most frequent one.

    One pass: rows are summed up per file, with one counter per category of the rule table,
    and the files per key. Ties go to the earlier category.
    """
    per_file = findings.groupBy(*keys, file).agg(
        F.count("*").alias("total"), F.count_if("is_vulnerable").alias("vulnerable"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk"),
        *[F.count_if(F.col("cwe_category") == c).alias(f"_c{i}")
          for i, c in enumerate(categories)])
    summed = per_file.groupBy(*keys).agg(
        F.sum("total").alias("total"), F.sum("vulnerable").alias("vulnerable"),
        F.sum("high_risk").alias("high_risk"), F.count("*").alias("files"),
        *[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(categories))])
    ranked = F.array(*[F.struct(F.col(f"_c{i}").alias("n"), F.lit(-i).alias("rank"),
                                F.lit(c).alias("cwe")) for i, c in enumerate(categories)])
    seen = F.filter(ranked, lambda s: s["n"] > 0)
    return (summed.withColumn("safe", F.col("total") - F.col("vulnerable"))
            .withColumn("cwes", F.nullif(F.size(seen), F.lit(0)).cast("bigint"))
            .withColumn("top_cwe", F.array_max(seen)["cwe"])
            .drop(*[f"_c{i}" for i in range(len(categories))]))


def with_grade(counters: DataFrame) -> DataFrame:
    rate = scoring.vulnerability_rate(F.col("vulnerable"), F.col("total"))
    return (counters.withColumn("_rate", rate)
            .withColumn("rate", F.bround("_rate", 4))
            .withColumn("grade", scoring.security_grade(F.col("_rate")))
            .drop("_rate"))


def cwe_distribution(findings: DataFrame, keys: Sequence[str] = (), order: str | None = None
                     ) -> DataFrame:
    """Flagged rows per category, most frequent first, then first seen."""
    flagged = findings.where(F.col("is_vulnerable") & (F.col("cwe_category") != fixed.NO_CWE))
    aggs = [F.count("*").alias("n")]
    if order:
        aggs.append(F.min(order).alias("first_seen"))
    out = flagged.groupBy(*keys, "cwe_category").agg(*aggs)
    sort = [F.desc("n"), F.asc("first_seen")] if order else [F.desc("n"), F.asc("cwe_category")]
    return (out.withColumn("cwe_id", scoring.cwe_id(F.col("cwe_category")))
            .withColumn("cwe_name", scoring.cwe_name(F.col("cwe_category")))
            .orderBy(*sort))


