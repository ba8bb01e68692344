"""Alignment of two tokenizers over a corpus: which tokens cover the same bytes, and how often.

Both libraries encode "space + text". Byte offsets where a token of either ends cut the tokens
into groups; every token of the one is linked to every token of the other in its group. All steps on
tokens are Arrow or array operations on whole batches. Chunks that both libraries encode on their
own are encoded once and remembered for a while, and a long text is worked on in parts
cut where neither has a token across.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import chunks
from riskloom.session import settle

SLICE = 1 << 19
# Pairs counted in a task before they are merged, links written out at once, pairs that are broadcast.
MERGE_ROWS, LINKS_AT_ONCE, KNOWN = 1 << 19, 1 << 20, 1 << 20
KEPT = 100_000  # distinct chunks remembered
MARK = "\u2581"  # fixed value: the piece vocabulary's space
_BYTE = re.compile("<0x([0-9A-F]{2})>").fullmatch
# A space between two of these may be cut: see `chunks`, and `PieceSide.cuts`.
_CUT = f"([{chunks._SAFE}]) ([{chunks._SAFE}])"
_UNSAFE = f"[^{chunks._SAFE}] | [^{chunks._SAFE}]|^ | $"
_PART = re.compile(_CUT)


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _spaced(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(_large(""), texts, _large(" "))


class ByteSide(chunks.Encoder):
    """Byte-level BPE of "space + text", special strings taken as plain text."""

    def __init__(self, spec: str):
        super().__init__(spec, KEPT)
        self.tokenizer.encode_special_tokens = True
        self.words.special = lambda chunk: None
        letters = {chr(letter): byte for byte, letter in chunks.byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        table = [b""] * (1 + max(vocabulary.values()))
        for token, at in vocabulary.items():
            table[at] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes = pa.array(table, pa.binary())

    def rows(self, texts: Sequence[str]) -> list[memoryview]:
        return [memoryview(row).cast(self.code) for row in self._values([f" {text}" for text in texts])]


class PieceSide:
    """Pieces of a model that puts a space before the text and escapes spaces."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        plan = proto.ModelProto.FromString(model)
        normal = plan.normalizer_spec
        # Where no piece has a space after another character, none reaches over a space between two words.
        self.cuts = (normal.add_dummy_prefix and not normal.remove_extra_whitespaces
                     and normal.escape_whitespaces and not normal.precompiled_charsmap
                     and not any(re.search(f"[^{MARK}]{MARK}", p.piece) or p.type == p.USER_DEFINED
                                 for p in plan.pieces))
        self.bytes = pa.array([self._bytes(p.piece) for p in plan.pieces], pa.binary())

    @staticmethod
    def _bytes(piece: str) -> bytes:
        byte = _BYTE(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode()

    def rows(self, texts: Sequence[str]) -> list[list[int]]:
        return self.pieces.encode(list(texts), num_threads=1)


class Sides:
    """Both libraries over texts that are not empty; chunks between two cuts are encoded once."""

    def __init__(self, spec: str, model: bytes, keep: int = KEPT):
        self.both = (ByteSide(spec), PieceSide(model))
        self.memory = chunks.Remembered(self._values, keep)
        # What follows a space that was cut away: the space that either side puts first stands for it.
        self.cuts = self.both[1].cuts and self.both[0].words.find is not None

    def _values(self, texts: Sequence[str]) -> list[bytes]:
        """Per text: how many ids the first side has, those ids, and those of the second side."""
        out = []
        for a, b in zip(*(side.rows(texts) for side in self.both), strict=True):
            value = array("I", (len(a),))
            value.extend(a)
            value.extend(b)
            out.append(value.tobytes())
        return out

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of texts and where each text's begin: cut at single spaces that are safe for both."""
        if not self.cuts:
            return texts, np.arange(len(texts) + 1)
        plain = pc.replace_substring(texts, " ", "\0")
        awkward = pc.match_substring_regex(texts, _UNSAFE)
        if pc.any(awkward).as_py():
            some = pc.replace_substring_regex(texts.filter(awkward), _CUT, "\\1\0\\2")
            plain = pc.replace_with_mask(plain, awkward, some)
        holed = pc.match_substring(texts, "\0")
        parts = pc.split_pattern(plain, "\0")
        if not pc.any(holed).as_py():
            return parts.flatten(), parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        lists = [[t] if h else p for t, h, p in  # a text with the mark itself is one chunk
                 zip(texts.to_pylist(), holed.to_pylist(), parts.to_pylist(), strict=True)]
        return (pa.array([x for p in lists for x in p], pa.large_string()),
                np.cumsum([0, *map(len, lists)]))

    def tokens(self, texts: pa.Array) -> list[Tokens]:
        flat, starts = self.cut(texts)
        words, index = chunks.distinct(flat)
        values = self.memory.of(words)
        all_ids = np.frombuffer(b"".join(values), np.uint32)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        at = np.cumsum(sizes) - sizes
        first = all_ids[at].astype(np.int64) if len(at) else at
        out = []
        for side, begin, size in zip(self.both, (at + 1, at + 1 + first), (first, sizes - 1 - first), strict=True):
            n = size[index]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = all_ids[np.repeat(begin[index] - ends[:-1], n) + np.arange(ends[-1])]
            out.append(Tokens(side.bytes, ids.astype(np.int32), ends[starts]))
        return out


class Tokens:
    """The tokens of some texts by one side, as a list column over Arrow tables."""

    def __init__(self, table: pa.Array, ids: np.ndarray, starts: np.ndarray):
        self.table, self.starts = table, starts
        self.lists = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(ids))

    def spelled(self) -> pa.Array:
        """The joined bytes of each text's tokens."""
        raw = self.table.cast(pa.large_binary()).take(pc.list_flatten(self.lists))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(self.starts), raw), pa.scalar(b"", pa.large_binary()))

    def keep(self, rows: pa.Array) -> None:
        self.lists = self.lists.take(rows)
        sizes = pc.list_value_length(self.lists).to_numpy(zero_copy_only=False)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.lists = pa.LargeListArray.from_arrays(pa.array(self.starts), pc.list_flatten(self.lists))

    def ends(self) -> pa.Table:
        """(doc, end, at): the byte offset in its text where each token ends, and the token's place."""
        doc, ids = pc.list_parent_indices(self.lists), pc.list_flatten(self.lists)
        size = pc.binary_length(self.table).cast(pa.int64()).take(ids)
        running = pc.cumulative_sum(size)
        before = np.concatenate([[0], running.to_numpy()])[self.starts[:-1]]
        end = pc.subtract(running, pa.array(before).take(doc))
        return pa.table({"doc": doc, "end": end, "at": pa.array(np.arange(len(ids)))})


class Aligner:
    """Groups and linked pairs of whole texts; a pair is first id x `width` + second id."""

    def __init__(self, spec: str, model: bytes, links: int = LINKS_AT_ONCE):
        self.sides, self.links = Sides(spec, model), links
        sizes = [len(side.bytes) for side in self.sides.both]
        self.width = sizes[1]
        self.names = [pa.array([str(i) for i in range(size)], pa.large_string()) for size in sizes]

    def align(self, texts: pa.Array) -> dict:
        """For texts that are not empty: arrays n_a, n_b, n_groups, n_links, groups, and a table (doc, pair, m)."""
        texts = texts.cast(pa.large_string())
        sides = self.sides.tokens(texts)
        whole = _spaced(texts).cast(pa.large_binary())
        good = pc.and_(*[pc.equal(side.spelled(), whole) for side in sides])
        rows = np.flatnonzero(good.to_numpy(zero_copy_only=False))
        if len(rows) < len(texts):
            for side in sides:
                side.keep(pa.array(rows))
        a, b = (side.ends() for side in sides)
        shared = a.join(b, keys=["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
        # Ends rise within a text and texts follow each other, so both sides' places rise together.
        edges = [np.sort(shared.column(name).to_numpy()) + 1 for name in ("at", "at_b")]
        doc = a.column("doc").to_numpy()[edges[0] - 1]
        groups = [np.concatenate([[0], edge]).astype(np.int64) for edge in edges]
        sizes = [np.diff(group) for group in groups]
        ids = [pc.list_flatten(side.lists) for side in sides]
        n = len(rows)
        per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int64)
        joined = [pc.binary_join(pa.LargeListArray.from_arrays(pa.array(group), names.take(values)), _large(","))
                  for group, names, values in zip(groups, self.names, ids, strict=True)]
        lines = pc.binary_join_element_wise(*joined, _large("|"))
        spelled = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(per_doc), lines), _large(";"))
        products = sizes[0] * sizes[1]
        return {"rows": rows, "n_a": np.diff(sides[0].starts), "n_b": np.diff(sides[1].starts),
                "n_groups": np.diff(per_doc), "groups": spelled,
                "n_links": np.bincount(doc, products, n).astype(np.int64),
                "pairs": self._pairs(doc, groups, sizes, products, [x.to_numpy() for x in ids])}

    def _pairs(self, doc, groups, sizes, products, ids) -> pa.Table:
        """(doc, pair, m): linked pairs of each text and how many links each has, by doc."""
        blocks, at, ends = [], 0, np.cumsum(products)
        while at < len(products):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + self.links, side="right")))
            if products[at] > self.links:
                blocks += self._large(doc[at], *(x[g[at]:g[at + 1]] for x, g in zip(ids, groups, strict=True)))
                at += 1
                continue
            some = slice(at, stop)
            n = products[some]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(sizes[1][some], n)
            a = ids[0][np.repeat(groups[0][:-1][some], n) + within // width]
            b = ids[1][np.repeat(groups[1][:-1][some], n) + within % width]
            links = pa.table({"doc": np.repeat(doc[some], n), "pair": a * self.width + b})
            blocks.append(links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
                          .rename_columns(["doc", "pair", "m"]))
            at = stop
        if not blocks:
            return pa.table({name: pa.array([], pa.int64()) for name in ("doc", "pair", "m")})
        pairs = pa.concat_tables(blocks)
        if len(blocks) > 1:
            pairs = (pairs.group_by(["doc", "pair"], use_threads=False).aggregate([("m", "sum")])
                     .rename_columns(["doc", "pair", "m"]))
        return pairs.sort_by("doc") if np.any(np.diff(pairs.column("doc").to_numpy()) < 0) else pairs

    def _large(self, doc: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.Table]:
        """One group of very many links: distinct ids of both sides with their numbers, block by block."""
        (a, na), (b, nb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        step = max(1, self.links // len(b))
        for at in range(0, len(a), step):
            pair = (a[at:at + step, None] * self.width + b).ravel()
            yield pa.table({"doc": np.full(len(pair), doc), "pair": pair,
                            "m": (na[at:at + step, None] * nb).ravel()})


def text_parts(text: str, limit: int = SLICE) -> Iterator[str]:
    """A long text in parts of about `limit` letters; the space between two parts is left out."""
    at = 0
    while len(text) - at > limit:
        found = _PART.search(text, at + limit)
        if found is None:
            break
        yield text[at:found.end(1)]
        at = found.start(2)
    yield text[at:]


# Rows of documents, and rows of counts: pairs that `m` documents of a task hold, without a digest.
SCHEMA = pa.schema([("key", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                    ("pairs", pa.list_(pa.int64())), ("m", pa.list_(pa.int64()))])
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_batch(aligner: Aligner, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Rows of SCHEMA for some texts, null and empty ones among them."""
    some = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    if not len(some):
        none = pa.array([0] * len(texts), pa.int64())
        return pa.RecordBatch.from_arrays(
            [keys, none, none, none, none, pa.array([""] * len(texts)), *[pa.array([[]] * len(texts), pa.list_(pa.int64()))] * 2],
            schema=SCHEMA)
    found = aligner.align(texts.take(pa.array(some)))
    rows = some[found["rows"]]
    columns = [np.zeros(len(texts), np.int64) for _ in _COUNTS]
    for column, name in zip(columns, _COUNTS, strict=True):
        column[rows] = found[name]
    digests = np.full(len(texts), "", object)
    digests[rows] = [hashlib.sha256(g.as_buffer()).hexdigest() for g in found["groups"]]
    pairs = found["pairs"]
    sizes = np.zeros(len(texts), np.int64)
    sizes[rows] = np.bincount(pairs.column("doc").to_numpy(), minlength=len(rows))
    starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    lists = [pa.ListArray.from_arrays(starts, pairs.column(name).combine_chunks()) for name in ("pair", "m")]
    return pa.RecordBatch.from_arrays([keys, *map(pa.array, columns), pa.array(digests, pa.string()), *lists],
                                      schema=SCHEMA)


def aligned_parts(aligner: Aligner, key: pa.Array, text: str, limit: int) -> pa.RecordBatch:
    """The row of SCHEMA of one long text, part by part; all or nothing if a part is spelled otherwise."""
    digest, total, pairs = hashlib.sha256(), dict.fromkeys(_COUNTS, 0), []
    for i, part in enumerate(text_parts(text, limit)):
        found = aligner.align(pa.array([part]))
        if not len(found["rows"]):
            return aligned_batch(aligner, key, pa.array([None], pa.string()))
        for name in _COUNTS:
            total[name] += int(found[name][0])
        digest.update((b";" if i else b"") + found["groups"][0].as_py().encode())
        pairs.append(found["pairs"].select(["pair", "m"]))
        if sum(map(len, pairs)) > MERGE_ROWS:
            pairs = [_summed(pairs)]
    merged = _summed(pairs)
    lists = [pa.array([merged.column(name).to_numpy()], pa.list_(pa.int64())) for name in ("pair", "m")]
    return pa.RecordBatch.from_arrays([key, *(pa.array([total[name]], pa.int64()) for name in _COUNTS),
                                       pa.array([digest.hexdigest()]), *lists], schema=SCHEMA)


def _summed(tables: list[pa.Table]) -> pa.Table:
    return (pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("m", "sum")])
            .rename_columns(["pair", "m"]))


class PairCounts:
    """How many documents hold each pair, merged in Arrow, handed on when there are `MERGE_ROWS` pairs."""

    def __init__(self):
        self.tables, self.size = [], 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pairs = pa.table({"pair": pc.list_flatten(batch.column("pairs"))})
        if len(pairs):
            self.tables.append(pairs.group_by("pair", use_threads=False).aggregate([([], "count_all")])
                               .rename_columns(["pair", "m"]))
            self.size += len(self.tables[-1])
        if self.size > MERGE_ROWS:
            self.tables = [_summed(self.tables)]
            self.size = len(self.tables[0])
            if self.size > MERGE_ROWS // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.tables:
            counted = _summed(self.tables)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(counted)], pa.int32()),
                                              counted.column(name).combine_chunks()) for name in ("pair", "m")]
            none = [pa.nulls(1, field.type) for field in list(SCHEMA)[:6]]
            yield pa.RecordBatch.from_arrays([*none, *lists], schema=SCHEMA)
        self.tables, self.size = [], 0


def align_documents(docs: DataFrame, spec: str, model: bytes, key: str, text: str, limit: int = SLICE) -> DataFrame:
    """SCHEMA's columns for every row of `docs` and for the pairs of each task: one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((spec, model))

    def align(batches):
        aligner, counts = chunks.opened(opened_aligner, shared.value), PairCounts()
        for batch in batches:
            keys, texts = batch.columns
            for at, part in chunks.slices(texts, limit):
                own = keys.slice(at, len(part))
                if len(part) == 1 and (pc.binary_length(part)[0].as_py() or 0) > limit:
                    rows = aligned_parts(aligner, own, part[0].as_py(), limit)
                else:
                    rows = aligned_batch(aligner, own, part)
                yield rows
                yield from counts.add(rows)
        yield from counts.rest()

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(align, "key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                                  "groups_sha256 string, pairs array<bigint>, m array<bigint>")


def opened_aligner(shared: tuple[str, bytes]) -> Aligner:
    return Aligner(*shared)


def count_pairs(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, is_best): how many rows hold each pair, and whether none of its first id has more."""
    counted = aligned.where("groups_sha256 is null").select(F.inline(F.arrays_zip("pairs", "m")))
    counts = settle(counted.groupBy(F.col("pairs").alias("pair")).agg(F.sum("m").alias("n")), "pair-counts")
    first = F.call_function("div", F.col("pair"), F.lit(width))
    # One row per id of the first vocabulary at most.
    best = counts.groupBy(first.alias("first")).agg(F.max("n").alias("best"))
    return counts.withColumn("first", first).join(F.broadcast(best), "first").select(
        "pair", "n", (F.col("n") == F.col("best")).alias("is_best"))


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id",
                     text: str = "text", known: int = KNOWN, limit: int = SLICE) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `docs`.

    A is a byte-level BPE of the tokenizers library, B a model of the sentencepiece library; both encode
    space + text, special strings as plain text. Byte offsets where a token of A and one of B end cut the tokens
    into groups; all occurrences of A and B in one group are linked. The count of a pair of ids is the number of
    rows that hold it linked. `n_best` are the links whose count is the highest of their A id, ties
    included; `count_sum` adds the counts of all links; `groups_sha256` is of all groups, written
    `a,a|b;a|b,b`. Null and empty texts, and those that either side spells otherwise, have no tokens: zeros, ''.

    Rows that repeat a key, or have none, are documents of their own; an empty table gives no rows;
    other columns are not read. Texts are encoded once; each text's distinct pairs are kept in the
    shared folder. The `known` most common pairs at most are broadcast; rarer ones, of which none is
    hot, are joined by a shuffle. Memory depends on `limit` bytes of text, a long text's distinct
    pairs and a group's distinct ids, not on the number of links.
    """
    with open(byte_path, encoding="utf-8") as file:
        spec = file.read()
    with open(piece_path, "rb") as file:
        model = file.read()
    width = len(PieceSide(model).bytes)
    aligned = settle(align_documents(docs, spec, model, key, text, limit)
                     .withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = settle(count_pairs(aligned, width), "pairs")
    # Pairs by the number of bits of their count: 63 rows at most.
    bits = dict(counts.groupBy(F.length(F.bin("n")).alias("bits")).count().collect())
    least, room = 63, known
    while least and bits.get(least, 0) <= room:
        room -= bits.get(least, 0)
        least -= 1
    common = F.length(F.bin("n")) > least
    rows = aligned.where("groups_sha256 is not null")
    links = rows.select("row", F.inline(F.arrays_zip("pairs", "m"))).withColumnRenamed("pairs", "pair")
    met = links.join(F.broadcast(counts.where(common)), "pair")
    if any(bits.get(b, 0) for b in range(least + 1)):
        rest = links.join(F.broadcast(counts.where(common).select("pair")), "pair", "left_anti")
        met = met.unionByName(rest.join(counts.where(~common), "pair"))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("m")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("m")).alias("count_sum"))
    zero = [F.coalesce(name, F.lit(0)).alias(name) for name in ("n_best", "count_sum")]
    return rows.drop("pairs", "m").join(sums, "row", "left").select(
        F.col("key").alias(key), *_COUNTS, *zero, "groups_sha256")
