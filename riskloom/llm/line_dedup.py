"""Lines that many documents share, dropped with DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.skew import compute_once
from riskloom.session import settle

# What is stripped from both ends of a line, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
SHORTEST, FEWEST = 20, 3
# A line that makes up more than one in so many shared lines is broadcast: there are fewer than that.
SHARES = 1_000


def line_key(line: Column) -> Column:
    """`line` without blanks at its ends, A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def keyed_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc, content, at, digest): 128 bits of the key of every line whose key is long enough.

    `docs` has `doc` and `text`; `content` tells apart the rows of one document.
    """
    lines = docs.select("doc", F.xxhash64("text").alias("content"),
                        F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keyed = compute_once(lines.where(F.length("line") >= shortest), key=line_key(F.col("line")))
    return keyed.where(F.length("key") >= shortest).select(
        "doc", "content", "at", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("digest"))


def shared_lines(lines: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(digest, n, last): keys found in at least `fewest` documents, and the largest holding each.

    A document counts once, however often it has the line: pairs are made distinct under both columns
    first, so a line of a third of all documents is spread over all tasks and then counted in
    parts. Rows without a document id are one document, smaller than all others.
    """
    pairs = lines.select("digest", "doc").distinct()
    return pairs.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(
        F.col("n") >= fewest)


def dropped_lines(lines: DataFrame, shared: DataFrame, shares: int = SHARES) -> DataFrame:
    """(doc, content, at) of the lines to drop. `lines` and `shared` are written tables.

    Lines that are a large part of all shared lines (fewer than `shares`, by their sum) are
    broadcast; what remains of `lines` has no hot key and is joined by its digest.
    """
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * shares > total
    common = F.broadcast(shared.where(hot))
    rest = lines.join(common.select("digest"), "digest", "left_anti").join(shared.where(~hot), "digest")
    found = lines.join(common, "digest").unionByName(rest)
    return found.where(~F.col("doc").eqNullSafe(F.col("last"))).select("doc", "content", "at")


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                        shortest: int = SHORTEST, fewest: int = FEWEST, shares: int = SHARES) -> DataFrame:
    """(key, text, n_lines, n_dropped): every row of `docs` without the lines that many documents share.

    A text is split at line feeds. A line's key is the line without blanks at its ends, A-Z lower-cased.
    Keys of at least `shortest` code points that are in at least `fewest` documents lose all their lines
    but those of the largest `key` holding them. Other lines stay as they are, in their order.
    Null and empty texts are one empty line, which stays; if all lines go the text is empty. Rows that
    repeat a key are one document when counted and are each given out; a null key is a document smaller than
    all others. An empty table gives no rows. Only key and text are read.

    Texts are split once for (document, place, digest), a written table; the text itself moves once, to
    meet the places that it loses, and is put together again by place. A task holds one
    document's lines at most.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = settle(keyed_lines(rows, shortest), "keyed-lines")
    shared = settle(shared_lines(lines, fewest), "shared-lines")
    lost = (dropped_lines(lines, shared, shares).groupBy("doc", "content")
            .agg(F.collect_set("at").alias("lost")).withColumnsRenamed({"doc": "d", "content": "c"}))
    own = rows.withColumn("content", F.xxhash64("text"))
    joined = own.join(lost, own.doc.eqNullSafe(lost.d) & (own.content == lost.c), "left")
    # Generated, since a plain column would be moved into the function below and split once per line.
    split = compute_once(joined, lines=F.split("text", "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.array_join(F.transform(places, lambda at: F.get("lines", at)), "\n")
    return split.select(
        F.col("doc").alias(key), F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept).alias(text),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"))
