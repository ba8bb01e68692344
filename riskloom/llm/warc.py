"""Web archives: write records with an index first, read selected records by coalesced ranges.

A record's payload is kept once: of equal payloads of at least `LEAST` bytes the page with the
smallest id is the response, the others are revisits that name it and hold no payload (their
HTTP header still states its length). Every record is a gzip member of its own, so the index
(file, offset, length, URL, digest) is enough to read any record alone.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import files
from riskloom.operators.skew import salted_join

LEAST = 100
FILE_BYTES = 256 << 20
STRIPE = 64 << 20
# Ranges closer than GAP are read as one, up to MOST bytes.
GAP = 64 << 10
MOST = 8 << 20

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = ("page_id bigint, file string, offset bigint, length bigint, url string, "
         "payload_digest string, record_type string")


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, html, digest, bytes, first): `first` is the page to refer to, null for a response.

    Only digests that occur more than once are joined back; their rows are salted, so that one payload
    with a third of all pages is not one task.
    """
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = (rows.withColumn("bytes", F.octet_length("html").cast("bigint"))
            .withColumn("digest", F.sha2("html", 256)))
    again = (rows.where(F.col("bytes") >= LEAST).groupBy("digest")
             .agg(F.min("key").alias("smallest"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    joined = salted_join(rows, again, ["digest"], "left", salt_from=("key", "url"))
    first = F.when(~F.col("key").eqNullSafe(F.col("smallest")), F.col("smallest"))
    return joined.select("key", "url", "html", "digest", "bytes", first.alias("first"))


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def make_record(key: int | None, url: str | None, html: bytes, digest: str, size: int, first: int | None) -> bytes:
    """One record, compressed. Control characters of a URL are percent-encoded, a null URL has no header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first is not None else http + html
    fields = [("WARC-Type", "response" if first is None else "revisit"),
              ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key} {digest}')}>"),
              ("WARC-Date", DATE),
              ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Length", str(len(block)))]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    if key is not None:
        fields.append(("X-Page-Id", str(key)))
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(first)),
                   ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{first} {digest}')}>")]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:20]!r}")
    fields = dict(line.decode().split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.decode().split(": ", 1) for x in http.split(b"\r\n")[1:]), payload


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of `plan_records`; one index row per record.

    A task attempt writes files with names of its own, and only the index of the attempt that
    Spark commits is kept. Files of lost attempts stay unnamed by any index.
    """
    def write(batches):
        system, base = files.open_folder(folder)
        system.create_dir(base, recursive=True)
        part, out, name, at, number = TaskContext.get().partitionId(), None, "", 0, 0
        mark = uuid.uuid4().hex[:12]
        for batch in batches:
            rows = []
            for key, url, html, digest, size, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, at, number = f"pages-{part:06d}-{number:04d}-{mark}.warc.gz", 0, number + 1
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                record = make_record(key, url, html.encode(), digest, size, first)
                out.write(record)
                rows.append({"page_id": key, "file": name, "offset": at, "length": len(record), "url": url,
                             "payload_digest": digest, "record_type": "response" if first is None else "revisit"})
                at += len(record)
                if at >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pylist(rows, pa.schema(
                [("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                 ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())]))
        if out is not None:
            out.close()

    return records.select("key", "url", "html", "digest", "bytes", "first").mapInArrow(write, INDEX)


def ranges(rows: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Coalesce (file, offset, length) in order: file, from, to, and the records inside."""
    now: tuple[str, int, int, list] | None = None
    for file, offset, length in rows:
        if now and now[0] == file and offset - now[2] <= GAP and offset + length - now[1] <= MOST:
            now[3].append((offset, length))
            now = (file, now[1], max(now[2], offset + length), now[3])
        else:
            if now:
                yield now
            now = (file, offset, offset + length, [(offset, length)])
    if now:
        yield now


def read_records(selected: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Read the records of the given index rows (any selection) back from the archives.

    Rows are laid out by file and stripe and sorted, near ranges are read at once. Gives
    page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, html
    (null for a revisit). The digest of a payload that was read is computed anew and must
    equal the one written.
    """
    def read(batches):
        system, base = files.open_folder(folder)
        opened, file = None, None

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        done: list[dict] = []
        size = 0
        for name, start, stop, inside in ranges(rows()):
            if name != opened:
                if file is not None:
                    file.close()
                opened, file = name, system.open_input_file(f"{base}/{name}")
            file.seek(start)
            data = file.read(stop - start)
            for offset, length in inside:
                row = _row(zlib.decompress(data[offset - start:offset - start + length], 31), payload)
                size += 200 + len(row.get("html") or "")
                done.append(row)
            if len(done) >= 10_000 or size >= MOST:
                yield pa.RecordBatch.from_pylist(done, schema)
                done, size = [], 0
        if file is not None:
            file.close()
        yield pa.RecordBatch.from_pylist(done, schema)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("html", pa.string())] * payload)
    ordered = (selected.select("file", "offset", "length")
               .withColumn("_stripe", F.floor(F.col("offset") / STRIPE))
               .repartition("file", "_stripe").sortWithinPartitions("file", "offset")
               .drop("_stripe"))
    return ordered.mapInArrow(read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
                              "record_type string, refers_to bigint" + ", html string" * payload)


def _row(record: bytes, payload: bool) -> dict:
    fields, http, body = parse_record(record)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"payload of page {fields.get('X-Page-Id')} does not fit its digest")
    refers, key = fields.get("X-Refers-To-Page-Id"), fields.get("X-Page-Id")
    row = {"page_id": None if key is None else int(key), "url": fields.get("WARC-Target-URI"),
           "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "record_type": kind,
           "refers_to": None if refers is None else int(refers)}
    return row | {"html": body.decode() if kind == "response" else None} if payload else row


def archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages under `folder`; returns the index, which is kept there as a table.

    Null html is empty; null URLs have no URI field; pages with a null id are never referred to;
    if a row with the smallest id is repeated, each of its rows is a response; an empty table
    gives an empty index; other columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    index = write_archives(plan_records(pages, key, url, html), f"{folder}/warc")
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")
