"""Writers for corpora, splits, vocabularies, summaries and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import METRIC_FIELDS

CLEAN_COLUMNS = ("code_clean", "language", "safety", "label")
NORMALISED_COLUMNS = ("code_clean", "normalized_code", "language", "safety", "label",
                      "token_length")
SPLIT_COLUMNS = ("normalized_code", "safety", "label", "token_length")
COMBINED_COLUMNS = ("normalized_code", "safety", "label", "cwe", "source_category",
                    "token_length")


def write_corpus_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    (df.select(*columns).write.mode("overwrite").option("header", True)
     .option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path))


def write_splits(encoded: DataFrame, paths: Sequence[str]) -> None:
    """Encoded rows by split; further paths are copies of the first, not recomputed."""
    first, *copies = paths
    encoded.select("split", "features", "label").write.mode("overwrite").partitionBy(
        "split").parquet(first)
    for path in copies:
        encoded.sparkSession.read.parquet(first).write.mode("overwrite").partitionBy(
            "split").parquet(path)


def write_vocabulary(vocabulary: DataFrame, path: str, as_json: bool = False) -> None:
    """(token, id) rows, or one JSON map (a vocabulary is at most its maximum size)."""
    if not as_json:
        vocabulary.write.mode("overwrite").parquet(path)
        return
    entries = F.array_sort(F.collect_list(F.struct("id", "token")))
    ordered = F.transform(entries, lambda e: F.struct(e["token"], e["id"]))
    vocabulary.agg(F.to_json(F.map_from_entries(ordered)).alias("value")).write.mode(
        "overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str, corpus: str, model: str) -> None:
    """One row of counts and ratios as the nested corpus -> model -> metrics document."""
    fields = [F.col(f.lower()).alias(f) for f in METRIC_FIELDS]
    nested = F.create_map(F.lit(corpus), F.create_map(F.lit(model), F.struct(*fields)))
    metrics.select(F.to_json(nested).alias("value")).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    """Write ordered line rows; the part files in name order are the document."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
