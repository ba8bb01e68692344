"""The rows of the whole pipeline against a plain one that takes a text at a time."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from riskloom.llm import chunks, langid, near_texts, quality  # noqa: E402
from test_texts import groups_by_force  # noqa: E402

BASE = "/root/testdata/sf0.001"
PIECES, WORDS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json"))


def quality_by_force(texts, model):
    """Probability of label 1: features of one text, their shares times their scores, and softmax."""
    values, table, bias = model
    out = []
    for text in texts:
        (found, share), = quality.bags(pa.array([text], pa.string()))
        odds = np.exp(share.astype(float) @ table[found].astype(float) + bias)
        out.append(float(odds[values.index(1)] / odds.sum()))
    return out


def language_by_force(texts, model):
    """(language, posterior): the words of one text one by one."""
    out = []
    for text in texts:
        words = langid.words_of(pa.array([text], pa.string()))[0].to_pylist()
        logs = np.log(model.prior) + sum((langid.word_scores(model, [w])[0] for w in words), np.zeros(len(model.prior)))
        odds = np.exp(logs - logs.max())
        known = any(c.isalpha() for w in words for c in w)
        out.append((model.languages[int(logs.argmax())], float(odds.max() / odds.sum())) if known else ("und", 0.0))
    return out


def test_scores_of_the_queries_by_force(spark):
    docs, labels = (spark.read.parquet(f"{BASE}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.orderBy("doc_id").collect()
    texts, import_entry = [r["text"] for r in rows], __import__("__spark_entry__")
    got = {r["doc_id"]: r for r in import_entry.queries()["op4_quality"](spark, BASE).collect()}
    want = quality_by_force(texts, quality.fit(docs, labels))
    np.testing.assert_allclose([got[r["doc_id"]]["score"] for r in rows], want, atol=1e-5)
    got = {r["doc_id"]: r for r in import_entry.queries()["op7_langid"](spark, BASE).collect()}
    want = language_by_force(texts, langid.fit(docs, PIECES))
    assert [got[r["doc_id"]]["lang_pred"] for r in rows] == [lang for lang, _ in want]
    np.testing.assert_allclose([got[r["doc_id"]]["score"] for r in rows], [p for _, p in want], atol=1e-8)


def test_rows_of_run_equal_a_plain_pipeline(spark):
    docs, labels = (spark.read.parquet(f"{BASE}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.orderBy("doc_id").collect()
    scores = quality_by_force([r["text"] for r in rows], quality.fit(docs, labels))
    assert min(abs(s - quality.KEEP) for s in scores) > 1e-6
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= quality.KEEP]
    frame = spark.createDataFrame(rows, docs.schema)
    found = language_by_force([r["text"] for r in rows], langid.fit(frame, PIECES))
    rows = [r for r, (lang, p) in zip(rows, found, strict=True) if lang != "und" and p >= langid.SURE]
    idf = near_texts.idf_weights(spark.createDataFrame(rows, docs.schema).select("text"))
    first = {key for (_, key), group in groups_by_force([(r["doc_id"], r["text"]) for r in rows], idf) if key == group}
    rows = [r for r in rows if r["doc_id"] in first]
    with open(WORDS, encoding="utf-8") as file:
        library = chunks.open_tokenizer(file.read())
    want = []
    for r in rows:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4")
            want.append((r["doc_id"], piece, at, len(part), zlib.crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, BASE).collect()
    assert sorted((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == sorted(want)
    sequences = defaultdict(list)
    for g in got:
        sequences[g["sequence_id"]].append((g["offset"], g["length"]))
    for places in sequences.values():
        places.sort()
        ends = np.cumsum([length for _, length in places])
        assert [at for at, _ in places] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(sequences) <= -(-sum(w[3] for w in want) // 4096) * 1.05 + 1


def test_stages_on_odd_rows_and_clashing_columns(spark):
    """Null and repeated ids, null and empty texts, a very long one, and columns the stages use themselves."""
    text = "some words that all of these rows share with each other and nothing else at all"
    rows = [(1, text), (1, text), (None, text), (2, text), (3, None), (4, ""), (5, "lone words " * 20_000), (6, "### 123")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, "a", "b", 2, 0.5) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 "_maybe string, _drop string, key long, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, BASE)
        assert kept.columns == docs.columns, name
        out = kept.collect()
        assert all(r["_maybe"] == "a" and r["_drop"] == "b" and r["key"] == 2 and r["score"] == 0.5 for r in out), name
        assert {(r["doc_id"], r["text"]) for r in out} <= set(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, BASE)
    assert packed.where("piece = 0").count() == len(rows)
