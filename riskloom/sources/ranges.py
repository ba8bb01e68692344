"""Large CSV and JSON files read by byte ranges, many tasks to a file.

What a byte means depends on all quotes before it. A first pass sums up each range for every state it may start
in; a scan over these small rows, one per range, tells the state each range really starts in; then every
task reads its own range on its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

RANGE_BYTES = 16 << 20
QUOTE, BACKSLASH, NEWLINE, RETURN = b'"\\\n\r'
BATCH_BYTES = 8 << 20


def file_ranges(files: DataFrame, step: int = RANGE_BYTES) -> DataFrame:
    """(path, start, size) for every `step` bytes of files (path, length), spread over the tasks."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step).cast("bigint"))
    cut = files.select("path", "length", F.explode(starts).alias("start"))
    return cut.select("path", "start", F.least(F.col("length") - F.col("start"), F.lit(step)).alias("size")).repartition(
        files.sparkSession.sparkContext.defaultParallelism, "path", "start")


def found_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length")


def read_range(path: str, start: int, size: int) -> bytes:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    system, plain = fs.FileSystem.from_uri(path)
    with system.open_input_file(plain) as file:
        file.seek(start)
        return file.read(size)


def _each(rows: DataFrame, work: Callable, schema: pa.Schema, types: str) -> DataFrame:
    """`work(row) -> list of tuples`, given out in batches of bounded size; row is a dict."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out, size = [], 0
                for record in work(row):
                    out.append(record)
                    size += sum(len(x) for x in record if isinstance(x, bytes))
                    if size > BATCH_BYTES:
                        yield _batch(out, schema)
                        out, size = [], 0
                if out:
                    yield _batch(out, schema)
    return rows.mapInArrow(run, types)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)


def _per_file(summaries: DataFrame, scan: Callable[[list[dict]], Iterator[tuple]], schema: pa.Schema, types: str
              ) -> DataFrame:
    """`scan` over the summaries of a file in order: a few numbers and names for each range."""
    inner = F.struct("start", *[c for c in summaries.columns if c not in ("path", "start")])
    listed = summaries.groupBy("path").agg(F.sort_array(F.collect_list(inner)).alias("ranges"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch([(row["path"], *r) for r in scan(row["ranges"])], schema)
    return listed.mapInArrow(run, types)


# --- JSON: {repository: {commit: value}} ---

def string_edges(raw: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that open or close a string; `escaped`: a backslash stands before `raw`."""
    quotes = np.flatnonzero(raw == QUOTE)
    slashes = np.flatnonzero(raw == BACKSLASH)
    fresh = np.diff(slashes, prepend=-2) > 1
    run = np.arange(len(slashes)) - np.maximum.accumulate(np.where(fresh, np.arange(len(slashes)), 0)) + 1
    if escaped and len(slashes) and slashes[0] == 0:  # the first run began before
        run = run + np.where(np.cumsum(fresh) == 1, 1, 0)
    before = np.zeros(len(quotes), np.int64)
    after = np.flatnonzero((quotes > 0) & (raw[quotes - 1] == BACKSLASH))
    before[after] = run[np.searchsorted(slashes, quotes[after] - 1)]
    if escaped and len(quotes) and quotes[0] == 0:
        before[0] = 1
    return quotes[before % 2 == 0]


def ends_escaped(raw: np.ndarray, escaped: bool) -> bool:
    other = np.flatnonzero(raw[::-1] != BACKSLASH)
    run = int(other[0]) if len(other) else len(raw) + escaped
    return bool(run % 2)


def brackets(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of brackets and what each adds to the depth."""
    opens, closes = ((raw == a) | (raw == b) for a, b in ((ord("{"), ord("[")), (ord("}"), ord("]"))))
    places = np.flatnonzero(opens | closes)
    return places, np.where(opens[places], 1, -1)


def summarise_json(raw: bytes) -> tuple:
    """For a range that starts plainly, and just after a backslash: strings opened or closed, depth gained
    if it starts outside and inside a string, and whether a backslash stands before the next range."""
    data = np.frombuffer(raw, np.uint8)
    places, steps = brackets(data)
    out: list = []
    for escaped in (False, True):
        edges = string_edges(data, escaped)
        odd = np.searchsorted(edges, places) % 2 == 1
        out += [len(edges), int(steps[~odd].sum()), int(steps[odd].sum()), ends_escaped(data, escaped)]
    return tuple(out)


_STATE = ("plain_edges", "plain_out", "plain_in", "plain_end", "escaped_edges", "escaped_out", "escaped_in",
          "escaped_end")


def json_states(ranges: list[dict]) -> Iterator[tuple[int, bool, bool, int]]:
    """(start, inside, escaped, depth) of each range of a file."""
    inside, escaped, depth = False, False, 0
    for r in ranges:
        yield r["start"], inside, escaped, depth
        now = "escaped" if escaped and inside else "plain"
        depth += r[f"{now}_in" if inside else f"{now}_out"]
        inside = inside ^ bool(r[f"{now}_edges"] % 2)
        escaped = r[f"{now}_end"]


def json_items(raw: bytes, inside: bool, escaped: bool, depth: int) -> Iterator[tuple]:
    """Values and one summary of a range whose starting state is known.

    Values are ("value", repository, commit, name of the repository, of the commit, text, begins, ends): numbers count
    from the start of the range (repository 0 is the one the range starts in); names that stand before
    the range are null. The summary is described at `json_starts`.
    """
    data = np.frombuffer(raw, np.uint8)
    edges = string_edges(data, escaped and inside)
    places, steps = brackets(data)
    outside = (np.searchsorted(edges, places) + inside) % 2 == 0
    places, depths = places[outside], depth + np.cumsum(steps[outside])
    opens = steps[outside] > 0
    # Strings at the depth of repositories (1) and commits (2): keys.
    first, last = edges[1 if inside else 0::2], edges[0 if inside else 1::2]
    level = np.concatenate([[depth], depths])
    head_kind, head, open_kind, open_text = 0, b"", 0, b""
    if inside and depth in (1, 2):
        head_kind, head = (depth, raw[:last[0]]) if len(last) else (-depth, raw)
    if inside:
        last = last[1:]
    if len(first) > len(last):
        at = int(first[-1])
        where = int(level[np.searchsorted(places, at)])
        if where in (1, 2):
            open_kind, open_text = where, raw[at + 1:]
        first = first[:len(last)]
    where = level[np.searchsorted(places, first)]
    keys = np.flatnonzero((where == 1) | (where == 2))
    events = [(int(last[i]), "key", int(where[i]), raw[first[i] + 1:last[i]]) for i in keys]
    events += [(int(p), "repo", 0, b"") for p in places[opens & (depths == 2)]]
    events += [(int(p), "begin", 0, b"") for p in places[opens & (depths == 3)]]
    events += [(int(p), "end", 0, b"") for p in places[~opens & (depths == 2)]]
    names: list[bytes | None] = [None, None]
    repo, commit, heads = 0, 0, None
    begun = 0 if depth >= 3 else None
    begins = False
    for at, kind, which, text in sorted(events):
        if kind == "key":
            names[which - 1] = text
        elif kind == "repo":
            heads = commit if heads is None else heads
            repo, commit = repo + 1, 0
        elif kind == "begin":
            begun, begins, commit = at, True, commit + 1
        else:
            yield "value", repo, commit - 1, *(names if begins else (None, None)), raw[begun:at + 1], begins, True
            begun, begins = None, False
    if begun is not None:
        yield "value", repo, commit - 1, *(names if begins else (None, None)), raw[begun:], begins, False
    yield "range", repo, commit, *names, json.dumps(
        [commit if heads is None else heads, head_kind, head.decode("latin-1"), open_kind, open_text.decode("latin-1")]
    ).encode(), False, False


def json_starts(ranges: list[dict]) -> Iterator[tuple]:
    """(start, repository, next commit, names of both) at the start of each range of a file.

    A range tells how many repositories it opens, how many commits follow the last of these (`commit`) and
    stand before the first (`heads`), its last keys, the rest of a key it starts in (`head`; a negative kind: the key
    goes on after the range) and the beginning of a key it ends in.
    """
    repo, commit, names, part = -1, 0, [None, None], b""
    for r in ranges:
        heads, head_kind, head, open_kind, open_text = json.loads(r["text"])
        if head_kind:
            part += head.encode("latin-1")
        if head_kind > 0:
            names[head_kind - 1], part = part, b""
        yield r["start"], repo, commit, *(None if n is None else json.loads(b'"' + n + b'"') for n in names)
        repo, commit = repo + r["repo"], r["commit"] if r["repo"] else commit + heads
        names = [old if new is None else new for old, new in zip(names, (r["repo_name"], r["commit_name"]), strict=True)]
        if open_kind:
            part = open_text.encode("latin-1")


def read_commits(files: DataFrame, step: int = RANGE_BYTES) -> DataFrame:
    """(path, repo_pos, repo, commit_pos, commit, value) of JSON files {repo: {commit: value}}, one row per commit.

    `files` has path and length. No task reads more than its range; the parts of a value that lies in several are
    put together at the end. Repositories and commits are numbered in the order of the file.
    """
    ranges = file_ranges(files, step)
    numbers = pa.schema([("path", pa.string()), ("start", pa.int64()), *(
        (n, pa.bool_() if n.endswith("_end") else pa.int64()) for n in _STATE)])
    summed = _each(ranges, lambda r: [(r["path"], r["start"], *summarise_json(read_range(r["path"], r["start"], r["size"])))],
                   numbers, "path string, start bigint, " + ", ".join(
                       f"{n} {'boolean' if n.endswith('_end') else 'bigint'}" for n in _STATE))
    states = _per_file(summed, json_states, pa.schema([
        ("path", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("escaped", pa.bool_()), ("depth", pa.int64())]),
        "path string, start bigint, inside boolean, escaped boolean, depth bigint")
    known = settle(ranges.join(states, ["path", "start"]), "json-ranges")
    items = _each(known.repartition(files.sparkSession.sparkContext.defaultParallelism, "path", "start"),
                  lambda r: ((r["path"], r["start"], *item) for item in json_items(
                      read_range(r["path"], r["start"], r["size"]), r["inside"], r["escaped"], r["depth"])),
                  pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("repo", pa.int64()),
                             ("commit", pa.int64()), ("repo_name", pa.binary()), ("commit_name", pa.binary()),
                             ("text", pa.binary()), ("begins", pa.bool_()), ("ends", pa.bool_())]),
                  "path string, start bigint, kind string, repo bigint, commit bigint, repo_name binary, "
                  "commit_name binary, text binary, begins boolean, ends boolean")
    found = settle(items, "json-items")
    starts = _per_file(found.where("kind = 'range'").drop("kind", "begins", "ends"), json_starts, pa.schema([
        ("path", pa.string()), ("start", pa.int64()), ("at_repo", pa.int64()), ("at_commit", pa.int64()),
        ("in_repo", pa.string()), ("in_commit", pa.string())]),
        "path string, start bigint, at_repo bigint, at_commit bigint, in_repo string, in_commit string")

    def name(column: str) -> F.Column:
        quoted = F.concat(F.lit('["'), F.col(column).cast("string"), F.lit('"]'))
        return F.get(F.from_json(quoted, "array<string>"), 0)

    here = F.col("repo") == 0
    placed = found.where("kind = 'value'").join(starts, ["path", "start"]).select(
        "path", "start", (F.col("at_repo") + F.col("repo")).alias("repo_pos"),
        F.coalesce(name("repo_name"), "in_repo").alias("repo"),
        (F.col("commit") + F.when(here, F.col("at_commit")).otherwise(0)).alias("commit_pos"),
        F.coalesce(name("commit_name"), "in_commit").alias("commit"), "text", "begins", "ends")
    whole = F.col("begins") & F.col("ends")
    columns = ["path", "repo_pos", "repo", "commit_pos", "commit"]
    parts = (placed.where(~whole).groupBy("path", "repo_pos", "commit_pos")
             .agg(F.min_by("repo", "start").alias("repo"), F.min_by("commit", "start").alias("commit"),
                  F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts")))
    joined = F.aggregate("parts", F.lit(b""), lambda text, part: F.concat(text, part["text"]))
    return placed.where(whole).select(*columns, F.col("text").cast("string").alias("value")).unionByName(
        parts.select(*columns, joined.cast("string").alias("value")))


# --- CSV with quoted line breaks ---

def summarise_csv(raw: bytes) -> tuple[int, int, int, int]:
    """Quotes, line ends outside quotes if the range starts outside, and if it starts inside quotes, and what
    its first line end is: 0 none, 1 a line feed, 2 a carriage return before it, 3 unknown (before the range);
    4 more if the range ends in a carriage return."""
    data = np.frombuffer(raw, np.uint8)
    quotes, lines = np.flatnonzero(data == QUOTE), np.flatnonzero(data == NEWLINE)
    odd = int((np.searchsorted(quotes, lines) % 2).sum())
    first = 0 if not len(lines) else 3 if lines[0] == 0 else 2 if raw[lines[0] - 1] == RETURN else 1
    return len(quotes), len(lines) - odd, odd, first + 4 * raw.endswith(b"\r")


def csv_starts(ranges: list[dict]) -> Iterator[tuple[int, bool, int, bool]]:
    """(start, inside quotes, records ended before, whether lines end in two characters) of each range of a file."""
    inside, ended, returned, crlf = False, 0, False, False
    for r in ranges:
        if r["first"] % 4:
            crlf = r["first"] % 4 == 2 or r["first"] % 4 == 3 and returned
            break
        returned = r["first"] >= 4
    for r in ranges:
        yield r["start"], inside, ended, crlf
        ended += r["odd"] if inside else r["even"]
        inside = inside ^ bool(r["quotes"] % 2)


def csv_records(path: str, start: int, size: int, inside: bool, ended: int, crlf: bool, step: int
                ) -> Iterator[tuple[int, bytes]]:
    """(number, text) of the records that begin in a range, after its first byte but for the first range, or
    right behind it; reads on to the end of the last one. Where lines end in two characters (`crlf`), so do
    quoted line breaks, and both become a line feed."""
    raw = read_range(path, start, size)
    data = np.frombuffer(raw, np.uint8)
    quotes, lines = np.flatnonzero(data == QUOTE), np.flatnonzero(data == NEWLINE)
    ends = lines[(np.searchsorted(quotes, lines) + inside) % 2 == 0]
    begins = np.concatenate([[0] if start == 0 else [], ends + 1]).astype(np.int64)
    if not len(begins):
        return
    number = ended + (start > 0)
    stops = ends[len(ends) - len(begins) + 1:] if len(begins) > 1 else ends[:0]
    for i, (a, b) in enumerate(zip(begins[:-1].tolist(), stops.tolist(), strict=True)):
        yield number + i, _line_feeds(raw[a:b], crlf)
    rest, at = raw[int(begins[-1]):], start + size
    odd = bool(rest.count(b'"') % 2)
    parts = [rest]
    while True:
        more = read_range(path, at, min(step, 1 << 20))
        if not more:
            break
        block = np.frombuffer(more, np.uint8)
        inner, found = np.flatnonzero(block == QUOTE), np.flatnonzero(block == NEWLINE)
        stop = found[(np.searchsorted(inner, found) + odd) % 2 == 0]
        if len(stop):
            parts.append(more[:int(stop[0])])
            break
        parts.append(more)
        odd ^= bool(len(inner) % 2)
        at += len(more)
    text = _line_feeds(b"".join(parts), crlf)
    if text:
        yield number + len(begins) - 1, text


def _line_feeds(record: bytes, crlf: bool) -> bytes:
    record = record.removesuffix(b"\r")
    return record.replace(b"\r\n", b"\n") if crlf else record


def read_records(files: DataFrame, step: int = RANGE_BYTES) -> DataFrame:
    """(path, number, record) of CSV files: a record is a line, or several where line breaks are quoted.

    The header is record 0. A task reads its range and the rest of the record that its range ends in.
    """
    ranges = file_ranges(files, step)
    summed = _each(ranges, lambda r: [(r["path"], r["start"], *summarise_csv(read_range(r["path"], r["start"], r["size"])))],
                   pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("start", "quotes", "even", "odd", "first"))]),
                   "path string, start bigint, quotes bigint, even bigint, odd bigint, first bigint")
    starts = _per_file(summed, csv_starts, pa.schema([("path", pa.string()), ("start", pa.int64()),
                                                      ("inside", pa.bool_()), ("ended", pa.int64()),
                                                      ("crlf", pa.bool_())]),
                       "path string, start bigint, inside boolean, ended bigint, crlf boolean")
    known = ranges.join(starts, ["path", "start"])
    return _each(known.repartition(files.sparkSession.sparkContext.defaultParallelism, "path", "start"),
                 lambda r: ((r["path"], *record) for record in csv_records(
                     r["path"], r["start"], r["size"], r["inside"], r["ended"], r["crlf"], step)),
                 pa.schema([("path", pa.string()), ("number", pa.int64()), ("record", pa.binary())]),
                 "path string, number bigint, record binary")
