"""Token operators against the tokenizers library, on whole tables and awkward texts."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry

public_tokenizers = pytest.importorskip("public_tokenizers")
from riskloom.llm import chunks, huffman, packing, prefix_bpe, token_counts, token_files  # noqa: E402

BASE = "/root/testdata/sf0.001"
BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
AWKWARD = ["", None, " ", "\n\n", "  a  b\n\nc \n d", "x\0y z", "<|endoftext|> a<|endoftext|>b <|startoftext|>",
           "ä ä́ ́x", "日本 語　x   y", " lead", "tail ", "it's we'll 'S", "a\r\nb\tc \x85 \xa0 d",
           "😀 😀 x", "İstanbul ΣΑΣ ǅ ß", "a" * 3_000, "word " * 20_000, "1234 5 ² ¼", "...a,b;c! ?"]


def spec_of(path):
    with open(path, encoding="utf-8") as file:
        return file.read()


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start long")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunked_encoding_equals_the_library(path):
    library, encoder = chunks.open_tokenizer(spec_of(path)), chunks.Encoder(spec_of(path), keep=50)
    counter, coder = chunks.Counter(spec_of(path), keep=50), prefix_bpe.TextCoder(spec_of(path), keep=50)
    random.seed(4)
    texts = AWKWARD + ["".join(random.choice("aabbcde'sthe  \n.,!?01ÀéßµΣ日😀́\t<|") for _ in range(random.randint(0, 60)))
                       for _ in range(1_500)]
    ids, starts = encoder.ids(pa.array(texts, pa.string()))
    counts, coded = counter.counts(pa.array(texts, pa.string())), coder.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[starts[i]:starts[i + 1]].tolist() == want
        assert counts[i] == len(want) == coded[i][0]
        assert coded[i][1].decode() == " ".join(map(str, want))
        assert coded[i][2].decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_many_ascii_chunks_at_once_equal_the_library(path):
    library, encoder = chunks.open_tokenizer(spec_of(path)), chunks.Encoder(spec_of(path))
    random.seed(6)
    texts = ["".join(random.choice("aAbBcde'stTHe  \n\n.,!?01<|_") for _ in range(random.randint(0, 40)))
             for _ in range(3_000)]
    words = encoder.words.many(texts)
    assert words is not None and words.count("\0") == len(texts) - 1
    values = encoder._many(words)
    assert [np.frombuffer(v, encoder.kind).tolist() for v in values] == [
        library.encode(t, add_special_tokens=False).ids for t in texts]
    for odd in ("a\tb", "\0", "<|endoftext|>", "é"):
        assert encoder.words.many(["a", odd]) is None


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_prefix_coder_encodes_every_token_to_itself_or_as_the_library(path):
    library, coder = chunks.open_tokenizer(spec_of(path)), prefix_bpe.TextCoder(spec_of(path))
    words = [t.removesuffix("</w>") for t in library.get_vocab(with_added_tokens=False)][::23]
    for word in words:
        assert coder.bpe.encode(word) == [t.id for t in library.model.tokenize(word)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=3_000), st.integers(9, 20))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, np.uint16)
    counts = np.bincount(ids, minlength=401)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit and (lengths[counts > 0] > 0).all()
    assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1
    codes = huffman.canonical(lengths)
    offsets, bits = huffman.encode(ids, lengths, codes, 64)
    table, width = huffman.decoding_table(lengths, codes)
    assert (huffman.decode(b"".join(bits), offsets, len(ids), 64, table, width) == ids).all()


def test_huffman_stretches_and_optimal_lengths(monkeypatch):
    monkeypatch.setattr(huffman, "STRETCH", 128)
    ids = np.random.default_rng(0).geometric(0.2, 5_000).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids))
    offsets, bits = huffman.encode(ids, lengths, huffman.canonical(lengths), 64)
    table, width = huffman.decoding_table(lengths, huffman.canonical(lengths))
    assert (huffman.decode(b"".join(bits), offsets, 5_000, 64, table, width) == ids).all()
    import heapq
    heap = [int(c) for c in np.bincount(ids) if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert cost == int((np.bincount(ids) * lengths).sum())


def library_ids(path, texts, end):
    library = chunks.open_tokenizer(spec_of(path))
    return [library.encode(t or "", add_special_tokens=False).ids + end for t in texts]


def test_token_counts(spark):
    want = library_ids(BYTES, AWKWARD, [])
    got = {r["doc_id"]: r for r in token_counts.count_tokens(table(spark, AWKWARD), BYTES).collect()}
    assert len(got) == len(AWKWARD)
    for i, ids in enumerate(want):
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["n_bytes"] == len((AWKWARD[i] or "").encode())
        assert got[i]["over_limit"] == (len(ids) > 512)
    assert token_counts.count_tokens(table(spark, []), BYTES).count() == 0
    assert token_counts.count_tokens(table(spark, ["a", "a"], [None, None]), BYTES).count() == 2


@pytest.mark.parametrize("file_ids", [64, 1 << 20])
def test_token_files_keep_ids_and_order(spark, tmp_path, file_ids):
    texts = [*AWKWARD, "same", "same"]
    keys = [*range(100, 100 + len(AWKWARD)), 7, 7]
    keys[3] = None
    token_files.write_corpus(table(spark, texts, keys), BYTES, str(tmp_path / "f"), 2, file_ids=file_ids)
    got = token_files.read_corpus(spark, str(tmp_path / "f")).collect()
    crc = token_files.read_corpus(spark, str(tmp_path / "f"), "ids_crc32").collect()
    order = sorted(range(len(texts)), key=lambda i: (keys[i] is not None, keys[i] or 0))
    ids = library_ids(BYTES, texts, [2])
    want, at = [], 0
    for i in order:
        want.append((keys[i], at, len(ids[i]), ids[i]))
        at += len(ids[i])
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert sorted(tuple(r) for r in crc if r["key"] is not None) == sorted(
        (k, s, n, zlib.crc32(np.array(x, "<u4").tobytes())) for k, s, n, x in want if k is not None)


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_corpus(table(spark, []), BYTES, str(tmp_path / "f"), 2)
    assert token_files.read_corpus(spark, str(tmp_path / "f")).count() == 0


def test_prefix_bpe_operator(spark):
    want = library_ids(WORDS, AWKWARD, [])
    library = chunks.open_tokenizer(spec_of(WORDS))
    got = {r["doc_id"]: r for r in prefix_bpe.encode_texts(table(spark, AWKWARD), WORDS).collect()}
    assert [got[i]["ids"] for i in range(len(want))] == want
    digests = {r["doc_id"]: r for r in prefix_bpe.digest_texts(table(spark, AWKWARD), WORDS).collect()}
    for i, ids in enumerate(want):
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i]["decoded"] == decoded
        assert digests[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert prefix_bpe.encode_texts(table(spark, []), WORDS).count() == 0


def check_packing(rows, docs, size=4_096):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for key, ids in docs:
        ids = np.array(ids, "<u4")
        want.setdefault(key, []).extend(
            (k, a, len(ids[a:a + size]), zlib.crc32(ids[a:a + size].tobytes()))
            for k, a in enumerate(range(0, len(ids), size)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    total = sum(n for pieces in by_sequence.values() for _, n in pieces)
    return len(by_sequence), -(-total // size)


def test_packing_operator(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 3)
    texts = [*AWKWARD, "again", "again", *["short words"] * 20]
    keys = [*range(len(AWKWARD)), 7, 7, *range(1_000, 1_020)]
    keys[2] = None
    rows = packing.pack(table(spark, texts, keys), WORDS, 1).collect()
    check_packing(rows, list(zip(keys, library_ids(WORDS, texts, [1]), strict=True)))
    assert packing.pack(table(spark, []), WORDS, 1).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 4_096), st.integers(1, 3_000), max_size=60))
def test_plans_use_every_piece_once(counts):
    groups = packing.plan(counts)
    used = {}
    for group in groups:
        assert sum(length * n for length, n in group.runs) + group.room == 4_096 and group.room >= 0
        for length, n in group.runs:
            used[length] = used.get(length, 0) + n * group.count
    assert used == counts
    base, runs = packing.layout(groups)
    assert sum(counts.values()) == 0 or runs["first"][0] == 0
    assert (np.diff(runs["first"]) > 0).all()


def test_packing_is_close_to_the_bound():
    random = np.random.default_rng(1)
    lengths = np.minimum(4_096, random.lognormal(6.5, 1, 20_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    sequences = sum(g.count for g in packing.plan(counts))
    assert sequences <= 1.005 * -(-int(lengths.sum()) // 4_096)


def test_fitted_repeats_are_least_squares():
    random = np.random.default_rng(2)
    matrix, target = random.random((12, 40)), random.random(12) * 5
    x = packing.fit(matrix, target)
    gradient = matrix.T @ (matrix @ x - target)
    assert (x >= 0).all() and (gradient > -1e-6).all() and abs(gradient[x > 0]).max() < 1e-6


def test_queries_on_the_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    docs.sort()
    texts = [t for _, t in docs]
    counts = {r["doc_id"]: r["n_tokens"] for r in entry.queries()["op10_token_counts"](spark, BASE).collect()}
    files = {r["doc_id"]: r for r in entry.queries()["op2_token_files"](spark, BASE).collect()}
    at = 0
    for (key, _), ids in zip(docs, library_ids(BYTES, texts, [2]), strict=True):
        assert counts[key] == len(ids) - 1
        assert (files[key]["start"], files[key]["n_tokens"]) == (at, len(ids))
        assert files[key]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    ids = library_ids(WORDS, texts, [])
    digests = {r["doc_id"]: r["ids_sha256"] for r in entry.queries()["op3_prefix_bpe"](spark, BASE).collect()}
    assert digests == {k: hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()
                       for (k, _), x in zip(docs, ids, strict=True)}
    packed = entry.queries()["op9_pattern_packing"](spark, BASE).collect()
    used, least = check_packing(packed, [(k, [*x, 1]) for (k, _), x in zip(docs, ids, strict=True)])
    assert used <= least + 1
