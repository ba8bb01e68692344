"""Connected components of a graph given as links, in rounds of shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.skew import salted_join
from riskloom.session import settle

# Links of one node from which on they are shared out over tasks.
HOT_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a bigint, b bigint): the smallest node reachable.

    Alternating stars: each node first hands the smallest node it knows to its larger neighbours,
    then to its smaller ones. Every round is written to the shared folder; rounds grow with the
    logarithm of the graph's diameter. Nodes with very many links are salted. Null ends and
    loops are no links; a node in no other link does not appear; no links give no rows.
    """
    now = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("a is not null and b is not null and a <> b").distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        now = settle(_small_star(_large_star(now)), "links")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    joined = salted_join(both.where("v > u"), least, ["u"], "inner", ("v",), "n", hot_rows=HOT_LINKS)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = salted_join(links, least, ["u"], "inner", ("v",), "n", hot_rows=HOT_LINKS)
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
