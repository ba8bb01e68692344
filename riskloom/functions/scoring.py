"""Scores, bands, grades and display rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def risk_level(flagged: Column, score: Column, bands=fixed.RULE_BANDS) -> Column:
    high, medium = bands
    return (F.when(~flagged, "SAFE").when(score >= high, "HIGH")
            .when(score >= medium, "MEDIUM").otherwise("LOW"))


def percent(confidence: Column) -> Column:
    """Whole percent, half to even."""
    return F.bround(confidence * 100, 0).cast("int")


def hybrid_flag(prob: Column, rule_hit: Column, threshold: Column | float) -> Column:
    return (prob >= threshold) | rule_hit


def hybrid_confidence(prob: Column, rule_hit: Column, flagged: Column) -> Column:
    return (F.when(flagged & rule_hit, F.greatest(prob, F.lit(fixed.RULE_CONFIDENCE)))
            .when(flagged, prob).otherwise(F.lit(1.0) - prob))


def hybrid_category(flagged: Column, rule_category: Column) -> Column:
    return F.when(flagged & (rule_category == fixed.NO_CWE), fixed.FALLBACK_CWE
                  ).otherwise(rule_category)


def cwe_id(category: Column) -> Column:
    return F.substring_index(category, ":", 1)


def cwe_name(category: Column) -> Column:
    return F.when(F.contains(category, F.lit(":")),
                  F.trim(F.split_part(category, F.lit(":"), F.lit(2)))).otherwise(category)


def vulnerability_rate(vulnerable: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(vulnerable, total) * 100, F.lit(0.0))


def security_grade(rate: Column) -> Column:
    return (F.when(rate == 0, "A+").when(rate <= 10, "B").when(rate <= 25, "C")
            .when(rate <= 40, "D").otherwise("F"))


def safety_score(safe: Column, total: Column) -> Column:
    return F.coalesce(F.floor(F.try_divide(safe, total) * 100), F.lit(100)).cast("int")


def scan_badge(high: Column, vulnerable: Column) -> Column:
    return F.when(high > 0, "HIGH").when(vulnerable > 0, "MEDIUM").otherwise("CLEAN")


def short_name(name: Column, length: int = 20) -> Column:
    return F.when(F.length(name) > length, F.concat(F.substring(name, 1, length), F.lit("..."))
                  ).otherwise(name)


def or_else(value: Column, default: str) -> Column:
    """The value, or a default when it is missing or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def action_slug(action: Column) -> Column:
    return F.replace(F.lower(action), F.lit("_"), F.lit("-"))


def minute_text(ts: Column) -> Column:
    return F.substring(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), 1, 16)


def pad_right(ids: Column, length: int = fixed.SEQUENCE_LENGTH) -> Column:
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(fixed.PAD_ID),
                                        F.greatest(F.lit(length) - F.size(cut), F.lit(0))))


def log_loss(prob: Column, label: Column, positive_weight: Column | float = 1.0,
             eps: float = 1e-7) -> Column:
    p = F.least(F.greatest(prob, F.lit(eps)), F.lit(1.0 - eps))
    return -(F.lit(positive_weight) * label * F.log(p) + (1 - label) * F.log(1 - p))
