"""Table maintenance as batch rewrites: each returns the new table content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import salted_join


def new_users(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of a registration batch that may be inserted, with defaults.

    The first row (by `ord`) of a user name and of an e-mail wins, as with unique keys; rows
    whose name or e-mail already exists are left out. Values are counted map-side before
    they are looked up, and the rows of a much-repeated value are shared out by salt.
    """
    free = batch
    for column in ("username", "email"):
        taken = (batch.groupBy(column).agg(F.count("*").alias("n_rows"))
                 .join(existing.select(column), column, "left_semi"))
        free = salted_join(free, taken, [column], "left_anti", ["ord"], "n_rows")
    by_name = free.groupBy("username").agg(F.min("ord").alias("ord")).select("ord")
    named = free.join(by_name, "ord", "left_semi")
    by_mail = named.groupBy("email").agg(F.min("ord").alias("ord")).select("ord")
    return (named.join(by_mail, "ord", "left_semi")
            .withColumn("role", F.lit("user")).withColumn("is_active", F.lit(1)))


def apply_updates(table: DataFrame, changes: DataFrame, columns: Sequence[str],
                  key: str = "id", order: str = "seq") -> DataFrame:
    """Latest non-null change per key and column; rows without a change stay as they are."""
    latest = changes.groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}")
        for c in columns])
    out = table.join(latest, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}
                           ).drop(*[f"_{c}" for c in columns])


def toggle_flag(table: DataFrame, requests: DataFrame, flag: str = "is_active",
                key: str = "id", actor: str = "admin_id") -> DataFrame:
    """Flip a 0/1 flag once per request; nobody flips their own, unknown keys do nothing."""
    flips = (requests.where(F.col(key) != F.col(actor)).groupBy(key)
             .agg(F.count("*").alias("_n")))
    return (table.join(flips, key, "left")
            .withColumn(flag, F.pmod(F.col(flag) + F.coalesce("_n", F.lit(0)), F.lit(2))
                        .cast("int")).drop("_n"))


def soft_delete(scans: DataFrame, requests: DataFrame) -> DataFrame:
    """Set `is_deleted` where id and owner match; `matched` tells whether they did."""
    wanted = requests.select("id", "user_id").distinct().withColumn("_hit", F.lit(True))
    return (scans.join(wanted, ["id", "user_id"], "left")
            .withColumn("matched", F.coalesce("_hit", F.lit(False)))
            .withColumn("is_deleted", F.when(F.col("matched"), 1)
                        .otherwise(F.col("is_deleted"))).drop("_hit"))
