"""Functions out of source files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

MODULE_NAME = "<module_main>"
BATCH_BYTES = 8 << 20


def functions_in(source: str) -> list[tuple[str, str, int]]:
    """(name, code, first line) of every plain `def`, outer ones first; the whole source
    under one name when there is none or it does not parse."""
    try:
        nodes = [n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.FunctionDef)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        nodes = []
    if not nodes:
        return [(MODULE_NAME, source, 1)] if source.strip() else []
    lines = source.splitlines()
    return [(n.name, "\n".join(lines[n.lineno - 1:n.end_lineno]), n.lineno) for n in nodes]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_id", pa.string()), ("fn", pa.int32()), ("name", pa.string()),
                        ("code", pa.string()), ("start_line", pa.int32())])
    rows, size = [], 0
    for batch in batches:
        for file_id, source in zip(batch.column(0), batch.column(1)):
            found = functions_in(source.as_py() or "")
            for i, (name, code, line) in enumerate(found):
                rows.append((file_id.as_py(), i, name, code, line))
                size += len(code)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)],
                        schema=schema)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def extract_functions(files: DataFrame, file_id: str = "file_id", code: str = "code"
                      ) -> DataFrame:
    """One row per function: (file_id, fn, name, code, start_line).

    The grammar needs a parser, so this one step runs in Python, over Arrow batches and
    with output bounded by bytes. Cleaning before and everything after stays native.
    """
    return files.select(F.col(file_id).cast("string").alias("file_id"),
                        F.col(code).alias("code")).mapInArrow(
        _extract, "file_id string, fn int, name string, code string, start_line int")


def segment_blocks(df: DataFrame, key: str, code: str, header: str) -> DataFrame:
    """Native twin: a block starts at a line matching `header` and runs up to the next line
    that is indented no deeper; (key, block, start_line, n_lines, first, block_code).

    Works inside the row on its own lines, so nothing is shuffled.
    """
    lines = text.splitlines(F.col(code))
    table = df.select(key, lines.alias("_l"))
    depth = F.transform("_l", lambda l: F.when(l.rlike(r"(?U)\S"), F.length(
        F.regexp_extract(l, r"\A[ \t]*", 0))).otherwise(1_000_000))
    table = table.withColumn("_d", depth)
    heads = F.filter(F.transform("_l", lambda l, i: F.when(l.rlike(header), i)),
                     lambda i: i.isNotNull())
    table = table.select("*", F.posexplode(heads).alias("block", "_at"))
    tail = F.slice("_d", F.col("_at") + 2, F.size("_d"))
    end = F.array_position(
        F.transform(tail, lambda d: d <= F.get("_d", F.col("_at"))), F.lit(True))
    n = F.when(end > 0, end).otherwise(F.size("_d") - F.col("_at")).cast("int")
    return table.withColumn("n_lines", n).select(
        key, "block", (F.col("_at") + 1).alias("start_line"), "n_lines",
        F.get("_l", F.col("_at")).alias("first"),
        F.array_join(F.slice("_l", F.col("_at") + 1, F.col("n_lines")), "\n")
        .alias("block_code"))


def with_source_line(functions: DataFrame, raw: Column, start: str = "start_line"
                     ) -> DataFrame:
    """Line in the original file for a line of the cleaned code (blank and comment-only
    lines are gone there)."""
    kept = F.filter(
        F.transform(text.splitlines(raw), lambda l, i: F.when(
            text.rstrip(F.substring_index(l, "#", 1)) != "", i + 1)),
        lambda i: i.isNotNull())
    return functions.withColumn("source_line", F.get(kept, F.col(start) - 1))
