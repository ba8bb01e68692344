"""Token counts of whole texts without keeping an id."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import chunks

OVER = 512


def count_tokens(docs: DataFrame, tokenizer_path: str, over: int = OVER,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of `docs`.

    Counts are those of `encode(text, add_special_tokens=False)` of the tokenizers library without
    truncation or padding; special strings inside a text count as the special token. An Arrow
    function returns lengths only. Its work is balanced by bytes: long texts are split at safe
    boundaries (see `chunks`), short ones share a batch. Null text counts as empty (0 bytes,
    0 tokens); null keys and repeated rows are kept as they are; an empty table gives no rows;
    other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def lengths(batches):
        counter = chunks.opened(chunks.Counter, spec.value)
        for batch in batches:
            texts = batch.column(1)
            for at, part in chunks.slices(texts):
                sizes = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                counts = pa.array(counter.counts(part), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), sizes, counts],
                    names=["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    counted = rows.mapInArrow(lengths, "key bigint, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > over).alias("over_limit"))
