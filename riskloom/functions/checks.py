"""Ordered data-quality rules: first failure, score, format tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def first_failure(value: Column, rules=fixed.PASSWORD_RULES) -> Column:
    """Message of the first rule the value breaks; null when all hold."""
    out = F.lit(None).cast("string")
    for pattern, message in reversed(rules):
        out = F.when(~value.rlike(pattern), message).otherwise(out)
    return out


def rules_met(value: Column, patterns=fixed.STRENGTH_PATTERNS) -> Column:
    score = F.lit(0)
    for pattern in patterns:
        score = score + value.rlike(pattern).cast("int")
    return score


def strength_label(score: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in fixed.STRENGTH_LABELS]), score + 1)


def valid_username(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z0-9_]+\z") & F.length(name).between(3, 20)


def valid_email(email: Column) -> Column:
    return email.rlike(r"(?U)\A[^@\s]+@[^@\s]+\.[^@\s]+\z")
