"""Text operators against brute force and held-out rows; the pipeline against its parts."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from riskloom.llm import bloom, langid, near_texts, quality, warc
from riskloom.llm.queries import public_tokenizers

BASE = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _score string"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 0, "clash") for k, t, lang in rows], DOCS)


def is_held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 0


# Near duplicates

def groups_by_force(rows, idf, similar=0.8):
    texts = pa.array([t for _, t in rows], pa.string())
    owner, found, times = near_texts.shingles(texts)
    weight = near_texts.weigh(found, times, idf).astype(float)
    bags = [dict(zip(found[owner == i].tolist(), weight[owner == i].tolist(), strict=True)) for i in range(len(rows))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][1] is None or rows[j][1] is None or rows[i][0] is None or rows[j][0] is None:
            continue
        a, b = bags[i], bags[j]
        union = sum(max(a.get(x, 0), b.get(x, 0)) for x in a.keys() | b.keys())
        shared = sum(min(a[x], b[x]) for x in a.keys() & b.keys())
        if rows[i][1] == rows[j][1] or (union and shared / union >= similar):
            root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i, (key, _) in enumerate(rows):
        members.setdefault(find(i), []).append(key)
    return sorted(((k is None, k or 0), min((x for x in m if x is not None), default=None) if len(m) > 1 else k)
                  for m in members.values() for k in m)


def shingles_by_force(text):
    words = text.lower().split()
    return [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def test_shingles():
    texts = ["a b c d e f", "A b  c\nd e F a b c d e f", "x y", "", None, "  ", " lead a b c d ", "é ü a b c d é ü a b c"]
    owner, found, times = near_texts.shingles(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        want = shingles_by_force(text or "")
        assert (owner == i).sum() == len(set(want))
        assert sorted(times[owner == i].tolist()) == sorted(want.count(x) for x in set(want))
    both = [set(found[owner == i].tolist()) for i in range(2)]
    assert both[0] < both[1]
    sliced = near_texts.shingles(pa.array(["zz", *texts], pa.string()).slice(1))
    assert all((a == b).all() for a, b in zip(sliced, (owner, found, times), strict=True))


@pytest.mark.parametrize("chunk", [3, 1_000])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_texts, "CHUNK", chunk)
    monkeypatch.setattr(near_texts, "TEXTS", chunk)
    random = np.random.default_rng(chunk)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(12):
        base = random.choice(vocabulary, 120).tolist()
        for _ in range(6):
            words = list(base)
            for place in random.choice(120, random.integers(0, 5), replace=False):
                words[place] = str(random.choice(vocabulary))
            rows.append((len(rows) + 5, " ".join(words)))
    passage = " ".join(random.choice(vocabulary, 60))
    rows += [(len(rows) + 5 + i, passage + " " + " ".join(random.choice(vocabulary, 100))) for i in range(10)]
    rows += [(500 + i, rows[0][1]) for i in range(8)]
    rows += [(600, None), (601, None), (602, ""), (603, ""), (604, "a b"), (605, "a b"), (606, "word " * 30_000),
             (None, rows[0][1]), (607, "b a")]
    df = docs_of(spark, [(k, t, None) for k, t in rows])
    idf = near_texts.idf_weights(df.select("text"))
    got = near_texts.near_duplicates(df).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["class_id"]) for r in got) == groups_by_force(rows, idf)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    stay = near_texts.keep_first(df)
    assert stay.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in stay.collect()) == sorted((r["doc_id"] or -1) for r in got if r["kept"])


def test_near_duplicates_of_nothing(spark):
    assert near_texts.near_duplicates(docs_of(spark, [])).count() == 0
    assert near_texts.keep_first(docs_of(spark, [])).count() == 0


def test_sampling_estimates_weighted_similarity(monkeypatch):
    monkeypatch.setattr(near_texts, "BANDS", 200)
    random = np.random.default_rng(0)
    found = np.sort(random.integers(0, 1 << 63, 400).astype(np.uint64))
    weights = random.uniform(0.5, 3, (2, 400)).astype(np.float32)
    drawn = [near_texts.samples(np.zeros(400, int), found, w, 1)[0] for w in weights]
    want = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    assert abs(np.mean(drawn[0] == drawn[1]) - want) < 0.06


def test_bloom_filter_never_misses(spark):
    keys = spark.range(0, 5_000, 3)
    marked = spark.range(-100, 5_000).select("id", bloom.may_hold(keys, "id", "id").alias("m")).collect()
    assert all(r["m"] for r in marked if r["id"] >= 0 and r["id"] % 3 == 0)
    assert sum(r["m"] for r in marked) < 2_100


def test_weights_come_from_exact_frequencies(spark):
    random = np.random.default_rng(7)
    common = " ".join(f"c{i}" for i in range(30))
    texts = [(common + " " if i % 3 == 0 else "") + " ".join(f"w{x}" for x in random.integers(0, 12, 40))
             for i in range(1_500)]
    texts += ["only this one says so", None, ""]
    idf = near_texts.idf_weights(docs_of(spark, [(i, t, None) for i, t in enumerate(texts)]).select("text"))
    _, found, _ = near_texts.shingles(pa.array(texts, pa.string()))
    seen, counts = np.unique(found, return_counts=True)
    frequent = counts > len(texts) // near_texts.RARE
    assert frequent.any() and not frequent.all()
    n = len(texts)
    want = 1 + 0.25 * np.minimum(1, np.log((n + 1) / (counts + 1)) / np.log(near_texts.RARE + 1))
    got = near_texts.weigh(seen, np.ones(len(seen), int), idf)
    assert np.allclose(got[frequent], want[frequent], atol=1e-6)
    assert np.allclose(got[~frequent], 1.25, atol=1e-6)


def test_near_duplicate_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    idf = near_texts.idf_weights(spark.read.parquet(f"{BASE}/documents.parquet").select("text"))
    got = entry.queries()["op8_minhash"](spark, BASE).collect()
    assert sorted(((False, r["doc_id"]), r["class_id"]) for r in got) == groups_by_force(rows, idf)


# Quality

def test_quality_on_held_out_rows(spark):
    base = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in entry.queries()["op4_quality"](spark, base).collect()}
    assert len(got) == spark.read.parquet(f"{base}/documents.parquet").count()
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{base}/labels.parquet").collect()]
    right = [got[k]["predicted"] == q for k, q in labels if is_held_out(k)]
    assert np.mean(right) >= 0.95
    assert all(r["held_out"] == is_held_out(k) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
               for k, r in got.items())


def test_quality_of_odd_rows(spark):
    rows = [(i, "good plain words here and there" if i % 2 else "### &&& $$$ %%%", None) for i in range(60)]
    rows += [(100, None, None), (101, "", None), (None, "good plain words", None), (102, "words " * 50_000, None), (1, "good", None)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (101, None), (3, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[5] > 0.5 > score[4]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    empty = labels.where("false")
    neutral = quality.score(docs, quality.fit(docs, empty)).collect()
    assert {r["score"] for r in neutral} == {0.5}
    assert quality.score(docs.where("false"), model).count() == 0


def test_folded_scores_equal_averaged_vectors():
    texts = pa.array(["one two two", "", "one", "ünï two three one"], pa.string())
    random = np.random.default_rng(1)
    table = random.normal(size=(1 << quality.BITS, 2)).astype(np.float32)
    bias = np.array([0.1, -0.2], np.float32)
    got = quality.probabilities(texts, table, bias)
    for i, (features, share) in enumerate(quality.bags(texts)):
        score = share.astype(float) @ table[features].astype(float) + bias
        want = np.exp(score - score.max())
        assert np.allclose(got[i], want / want.sum(), atol=1e-5)


# Language

def brute_word(model, word, column):
    word, number, total = langid.START + word, {p: i for i, p in enumerate(model.pieces)}, 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        places = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        chance = 1.0
        for a, b in itertools.pairwise(places):
            piece = number.get(word[a:b], -1 if b - a == 1 else None)
            chance *= 0.0 if piece is None else model.chance[piece, column]
        total += chance
    return np.log(total)


def test_forward_sums_all_segmentations():
    counts = {"a": [("the", 5), ("then", 2), ("cat", 1)], "b": [("das", 4), ("denn", 3), ("schön", 2)]}
    model = langid.learn(counts, {"a": 3, "b": 4}, langid.public_pieces(PIECES))
    for word in ("the", "schön", "日x", "catthen"):
        for column in range(2):
            assert abs(langid.word_scores(model, [word])[0, column] - brute_word(model, word, column)) < 1e-9
        assert np.allclose(langid.long_word(model, langid.START + word), langid.word_scores(model, [word])[0])
    assert np.allclose(model.chance[:-1].sum(0), 1)


def test_language_on_held_out_rows(spark):
    base = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in entry.queries()["op7_langid"](spark, base).collect()}
    docs = spark.read.parquet(f"{base}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs if is_held_out(r["doc_id"])]) >= 0.98
    assert all(r["held_out"] == is_held_out(k) and 0 <= r["score"] <= 1 for k, r in got.items())


def test_language_of_odd_rows(spark):
    rows = [(i, "the cat and then the hat" if i % 2 else "das haus und der schöne baum", "en" if i % 2 else "de")
            for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 !! ?", "de"), (103, "the " * 40_000, None),
             (104, "x" * 5_000, None), (None, "das haus", "de"), (105, "日本語", None), (1, "the cat", "en")]
    docs = docs_of(spark, rows)
    model = langid.fit(docs, PIECES)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert model.languages == ["de", "en"]
    assert {got[k]["lang_pred"] for k in (100, 101, 102)} == {"und"}
    assert (got[103]["lang_pred"], got[None]["lang_pred"], got[2]["lang_pred"]) == ("en", "de", "de")
    assert got[104]["lang_pred"] in ("de", "en")
    kept = langid.keep_known(docs, PIECES)
    assert kept.columns == docs.columns and {100, 101, 102}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert langid.identify(docs.where("false"), model).count() == 0
    nothing = langid.identify(docs, langid.fit(docs.where("false"), PIECES)).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


# Web archives

def test_archives_round_trip(spark, tmp_path):
    long = "x" * 99 + "ü"
    rows = [(1, "u", long), (2, "u\r\nv", long), (3, None, long), (None, "n", long), (5, "s", "short"), (4, "s", "short"),
            (6, "e", None), (7, "z", "y" * 300_000), (2, "u", long)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, bytes long")
    index = warc.archive(pages, str(tmp_path / "w"))
    got = warc.read_records(index, str(tmp_path / "w/warc"), payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for k, _, h in rows if k == r["page_id"])
        assert r["payload_bytes"] == len(html.encode())
        shared = html == long and r["page_id"] != 1
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if shared else ("response", None))
        assert r["html"] == (None if shared else html)
    some = warc.read_records(index.where("page_id in (2, 5)"), str(tmp_path / "w/warc")).collect()
    assert sorted(r["page_id"] for r in some) == [2, 2, 5]
    empty = warc.archive(pages.where("false"), str(tmp_path / "e"))
    assert warc.read_records(empty, str(tmp_path / "e/warc")).count() == 0


def test_near_ranges_are_read_at_once():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP, 5), ("a", 21 + 2 * warc.GAP, 5), ("b", 0, 4)]
    assert [(f, a, b, len(x)) for f, a, b, x in warc.ranges(rows)] == [
        ("a", 0, 20 + warc.GAP, 3), ("a", 21 + 2 * warc.GAP, 26 + 2 * warc.GAP, 1), ("b", 0, 4, 1)]


# Pipeline

def test_pipeline(spark):
    # The smallest tables have too few labels to learn what to reject.
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base)
        assert docs.columns == columns, name
        after = {r["doc_id"] for r in docs.collect()}
        assert after < before or name == "language" and after <= before
        before = after
    packed = entry.queries()["pipeline"](spark, base).collect()
    assert {r["doc_id"] for r in packed} == before


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_pass_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").where("false")
    assert stage(spark, docs, BASE).count() == 0
