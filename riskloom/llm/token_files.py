"""Token ids of a corpus as Huffman-coded files in document order.

A file is: magic, counts (documents, ids, blocks, ids per block, symbols, bytes of code lengths), then
code lengths (deflated), document keys with a null flag, ids per document, bit offset of
every block, bits. Each file can be decoded on its own. `manifest` lists the files in order with
the number of ids before each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import chunks, files, huffman

MAGIC = b"RLIDS01\n"
HEAD = struct.Struct("<6Q")
BLOCK = 512
FILE_IDS = 1 << 22
# Bytes encoded at once, and chunks and words remembered: nothing else is held beside the encoder here.
ENCODED_BYTES, REMEMBERED = 16 << 20, (450_000, 300_000)


def encode_documents(docs: DataFrame, spec: str, end_id: int | None, symbols: int,
                     key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, ids, used, times): little-endian ids of each whole text, deflated by zstd, `end_id` appended.

    Each task adds one row without `n` that holds the ids it used and how often.
    """
    shared = docs.sparkSession.sparkContext.broadcast((spec, *REMEMBERED))
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()),
                        ("used", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def encode(batches):
        encoder = chunks.opened(chunks.encoder, shared.value)
        codec, kind = pa.Codec("zstd", 1), encoder.kind
        end = np.array([] if end_id is None else [end_id], kind)
        tail, total = end.tobytes(), np.zeros(symbols, np.int64)
        for batch in batches:
            for at, part in chunks.slices(batch.column(1), ENCODED_BYTES):
                ids, starts = encoder.ids(part)
                total += np.bincount(ids, minlength=symbols)
                total[end] += len(part)
                raw, edges = ids.tobytes(), (starts * ids.itemsize).tolist()
                packed = [codec.compress(raw[a:b] + tail, asbytes=True)
                          for a, b in zip(edges, edges[1:], strict=False)]
                counts = np.diff(starts) + len(end)
                none = [pa.nulls(len(part), field.type) for field in list(schema)[3:]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(counts, pa.int64()),
                     pa.array(packed, pa.binary()), *none], schema=schema)
        used = np.flatnonzero(total)
        none = [pa.nulls(1, field.type) for field in list(schema)[:3]]
        yield pa.RecordBatch.from_arrays([*none, pa.array([used], pa.list_(pa.int32())),
                                          pa.array([total[used]], pa.list_(pa.int64()))], schema=schema)

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "key bigint, n bigint, ids binary, used array<int>, times array<bigint>")


def unpack(n: int, packed: bytes, kind: type, codec: pa.Codec) -> np.ndarray:
    return np.frombuffer(codec.decompress(packed, n * kind().itemsize), kind)


def count_ids(encoded: DataFrame, symbols: int) -> np.ndarray:
    """How often each id occurs in all documents; the result has one row per symbol at most."""
    rows = encoded.where("n is null").select(F.inline(F.arrays_zip("used", "times")))
    counts = np.zeros(symbols, np.int64)
    for id_, n in rows.groupBy("used").agg(F.sum("times")).collect():
        counts[id_] = n
    return counts


def id_type(symbols: int) -> type:
    return np.uint32 if symbols > 1 << 16 else np.uint16


def write_files(encoded: DataFrame, folder: str, lengths: np.ndarray, partitions: int,
                file_ids: int = FILE_IDS) -> DataFrame:
    """Write `encoded` (key, n, ids) in ascending key order (null keys first, ties by content); one row per file."""
    shared = encoded.sparkSession.sparkContext.broadcast(lengths)

    def write(batches):
        lengths = shared.value
        codes, kind = huffman.canonical(lengths), id_type(len(lengths))
        part, rows, codec = TaskContext.get().partitionId(), [], pa.Codec("zstd")
        keys, pieces, size = [], [], 0

        def flush():
            nonlocal keys, pieces, size
            name = f"part-{part:08d}-{len(rows):06d}.ids"
            body = file_body(keys, pieces, lengths, codes)
            rows.append((part, len(rows), name, len(keys), size, files.write_whole(folder, name, body)))
            keys, pieces, size = [], [], 0

        for batch in batches:
            for key, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(key)
                pieces.append(unpack(n, packed, kind, codec))
                size += n
                if size >= file_ids:
                    flush()
        if keys:
            flush()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "seq", "name", "n_docs", "n_ids", "bytes"), row, strict=True)) for row in rows],
            pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()),
                       ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64())]))

    ordered = encoded.repartitionByRange(partitions, "key").sortWithinPartitions("key", "ids")
    return ordered.mapInArrow(
        write, "part int, seq int, name string, n_docs bigint, n_ids bigint, bytes bigint")


def file_body(keys: list, pieces: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[bytes]:
    ids = np.concatenate(pieces) if pieces else np.zeros(0, np.uint16)
    offsets, bits = huffman.encode(ids, lengths, codes, BLOCK)
    deflated = zlib.compress(lengths.tobytes(), 6)
    return [MAGIC, HEAD.pack(len(keys), len(ids), len(offsets) - 1, BLOCK, len(lengths), len(deflated)), deflated,
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array([k is None for k in keys], "u1").tobytes(),
            np.array([len(p) for p in pieces], "<u8").tobytes(),
            offsets.astype("<u8").tobytes(), *bits]


def read_body(body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Keys, ids per document, and all ids of one file."""
    if body[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    docs, n_ids, blocks, block, symbols, packed = HEAD.unpack_from(body, 8)
    at = 8 + HEAD.size
    lengths = np.frombuffer(zlib.decompress(body[at:at + packed]), np.uint8)
    at += packed
    keys = np.frombuffer(body, "<i8", docs, at)
    nulls = np.frombuffer(body, "u1", docs, at + 8 * docs)
    counts = np.frombuffer(body, "<u8", docs, at + 9 * docs).astype(np.int64)
    offsets = np.frombuffer(body, "<u8", blocks + 1, at + 17 * docs)
    bits = body[at + 17 * docs + 8 * (blocks + 1):]
    if len(lengths) != symbols:
        raise ValueError("code lengths do not fit the number of symbols")
    table, width = _table(lengths)
    ids = huffman.decode(bits, offsets, n_ids, block, table, width)
    return [None if null else int(key) for key, null in zip(keys, nulls, strict=True)], counts, ids


_TABLES: dict = {}


def _table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    known = lengths.tobytes()
    if known not in _TABLES:
        _TABLES.clear()
        _TABLES[known] = huffman.decoding_table(lengths, huffman.canonical(lengths))
    return _TABLES[known]


def number_files(written: DataFrame) -> DataFrame:
    """Add `first_id`, the ids of all files before; there is one small row per file."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame, values: str = "ids") -> DataFrame:
    """Decode all files: (key, start, n_tokens) and, by `values`, ids array<bigint> or ids_crc32."""
    if values not in ("ids", "ids_crc32"):
        raise ValueError(values)

    def decode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, counts, ids = read_body(files.read_whole(folder, name))
                ends = np.cumsum(counts)
                starts = ends - counts
                if values == "ids":
                    last = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()),
                                                    pa.array(ids, pa.int64()))
                else:
                    raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in
                                     zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(starts + first, pa.int64()),
                     pa.array(counts, pa.int64()), last], names=["key", "start", "n_tokens", values])

    kind = "array<bigint>" if values == "ids" else "bigint"
    count = max(1, manifest.count())
    return manifest.select("name", "first_id").repartition(count).mapInArrow(
        decode, f"key bigint, start bigint, n_tokens bigint, {values} {kind}")


def write_corpus(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None,
                 key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode, count, code and write all documents; returns the manifest, also kept in the folder.

    Null text is empty (only `end_id`); null keys come first; repeated rows are all written, ties
    by content; an empty table gives no files. Only key and text are read. Encoding runs
    once and is kept as an intermediate table in `folder`; the driver sees one count per symbol
    and the code lengths, both bounded by the vocabulary. Lost tasks rewrite the same files.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    symbols = max(chunks.open_tokenizer(spec).get_vocab_size(with_added_tokens=True),
                  0 if end_id is None else end_id + 1)
    # Already deflated, so Parquet need not try again.
    encode_documents(docs, spec, end_id, symbols, key, text).write.option("compression", "none").parquet(f"{folder}/encoded")
    encoded = spark.read.parquet(f"{folder}/encoded")
    lengths = huffman.code_lengths(count_ids(encoded, symbols))
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts = encoded.where("n is not null").select("key", "n", "ids")
    number_files(write_files(texts, f"{folder}/ids", lengths, max(1, -(-total // file_ids)), file_ids)
                 ).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_corpus(spark: SparkSession, folder: str, values: str = "ids") -> DataFrame:
    return read_documents(spark, f"{folder}/ids", spark.read.parquet(f"{folder}/manifest"), values)
