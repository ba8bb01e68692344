"""Scan history and audit analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from .skew import salted_join


def active_rows(scans: DataFrame) -> DataFrame:
    return scans.where("is_deleted = 0")


def users_with_scan_count(users: DataFrame, scans: DataFrame) -> DataFrame:
    """Every user with the number of live scans; counted first, joined after."""
    counts = (active_rows(scans).groupBy(F.col("user_id").alias("id"))
              .agg(F.count("*").alias("scan_count")))
    return (users.join(counts, "id", "left")
            .withColumn("scan_count", F.coalesce("scan_count", F.lit(0)))
            .orderBy(F.desc("created_at"), F.desc("id")))


def audit_with_user(audit: DataFrame, users: DataFrame, limit: int = 50) -> DataFrame:
    """Newest audit rows with the user name; the top rows are cut before the join."""
    newest = audit.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    names = users.select(F.col("id").alias("user_id"), "username")
    return newest.join(names, "user_id", "left").orderBy(F.desc("timestamp"), F.desc("id"))


def newest_per_user(df: DataFrame, time: str, limit: int = 10, id: str = "id",
                    user: str = "user_id") -> DataFrame:
    """Newest rows per user. The rank filter is applied before the shuffle as well, so a
    busy user sends at most `limit` rows per task."""
    newest = Window.partitionBy(user).orderBy(F.desc(time), F.desc(id))
    return df.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= limit)


def recent_scans(scans: DataFrame, limit: int = 10) -> DataFrame:
    return newest_per_user(active_rows(scans), "scan_time", limit)


def recent_user_audit(audit: DataFrame, limit: int = 10) -> DataFrame:
    return newest_per_user(audit.where("user_id is not null"), "timestamp", limit)


def scan_trend(scans: DataFrame, limit: int = 5) -> DataFrame:
    """The newest scans of each user, oldest first, as chart points."""
    newest = recent_scans(scans, limit)
    total = F.greatest("total_functions", F.lit(1))
    upward = Window.partitionBy("user_id").orderBy(F.desc("rn"))
    return (newest.withColumn("point", F.row_number().over(upward))
            .withColumn("name", scoring.short_name(F.col("filename")))
            .withColumn("total_functions", total)
            .withColumn("percent", F.bround(F.col("vulnerable_count") / total * 100, 4))
            .select("user_id", "point", "name", "vulnerable_count", "total_functions",
                    "percent"))


def system_stats(users: DataFrame, scans: DataFrame) -> DataFrame:
    """Three totals; each side is reduced to one row first."""
    people = users.agg(F.count("*").alias("total_users"))
    totals = active_rows(scans).agg(
        F.count("*").alias("total_scans"),
        F.coalesce(F.sum("vulnerable_count"), F.lit(0)).alias("total_vulnerabilities"))
    both = people.unionByName(totals, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def user_scan_stats(scans: DataFrame) -> DataFrame:
    return active_rows(scans).groupBy("user_id").agg(
        F.count("*").alias("total_scans"),
        F.coalesce(F.sum("vulnerable_count"), F.lit(0)).alias("total_vulns"),
        F.max("scan_time").alias("last_scan_date"))


def owned_scans(scans: DataFrame, requests: DataFrame) -> DataFrame:
    """Live scans asked for by their owner: `requests` holds (id, user_id)."""
    return active_rows(scans).join(requests.select("id", "user_id").distinct(),
                                   ["id", "user_id"], "left_semi")


def rows_by_key(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def action_counts(audit: DataFrame) -> DataFrame:
    """Events per day and action, with day totals and a grand total, marked `all`.

    An event without a time or an action stays a row of its own with a null there.
    """
    day = F.date_format("timestamp", "yyyy-MM-dd")
    summed = audit.withColumn("day", day).rollup("day", "action").agg(
        F.count("*").alias("n"), *[F.grouping(c).alias(f"_all_{c}") for c in ("day", "action")])
    return summed.select(*[F.when(F.col(f"_all_{c}") == 1, "all").otherwise(F.col(c)).alias(c)
                           for c in ("day", "action")], "n")


def unique_violations(batch: DataFrame, existing: DataFrame, column: str) -> DataFrame:
    """Rows of a batch whose `column` is taken by another id or repeated in the batch.

    `existing` is unique in `column`. Repeats are counted per value, then looked up with
    the rows of a much-repeated value shared out by salt.
    """
    repeats = batch.groupBy(column).agg(F.count("*").alias("_n"))
    owner = existing.select(column, F.col("id").alias("_owner"))
    known = repeats.join(owner, column, "left").where(
        (F.col("_n") > 1) | F.col("_owner").isNotNull())
    known = known.withColumn("repeated", F.col("_n") > 1)
    joined = salted_join(batch, known, [column], "inner", ["id"], "_n")
    taken = F.coalesce(F.col("_owner") != F.col("id"), F.lit(False))
    return joined.withColumn("taken", taken).where("taken or repeated").drop("_owner")


def user_dashboard(scans: DataFrame) -> dict[str, DataFrame]:
    return {"recent": recent_scans(scans).withColumn("badge", scoring.scan_badge(
                F.col("high_risk_count"), F.col("vulnerable_count"))),
            "stats": user_scan_stats(scans), "trend": scan_trend(scans)}


def audit_display(audit: DataFrame, users: DataFrame, limit: int = 50) -> DataFrame:
    shown = audit_with_user(audit, users, limit)
    return shown.select(
        "id", scoring.minute_text(F.col("timestamp")).alias("at"),
        scoring.or_else(F.col("username"), "Anonymous").alias("username"),
        "action", scoring.action_slug(F.col("action")).alias("slug"),
        scoring.or_else(F.col("ip_address"), "N/A").alias("ip_address"),
        scoring.or_else(F.col("details"), "--").alias("details"))


def users_display(users: DataFrame) -> DataFrame:
    return users.withColumn("role_title", F.initcap("role")).withColumn(
        "last_seen", F.coalesce(scoring.minute_text(F.col("last_login")), F.lit("Never")))


def admin_overview(users: DataFrame, scans: DataFrame, audit: DataFrame
                   ) -> dict[str, DataFrame]:
    return {"stats": system_stats(users, scans),
            "users": users_display(users_with_scan_count(users, scans)),
            "audit": audit_display(audit, users)}
