"""Lines that repeat, two tokenizers side by side, and resampling, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

public_tokenizers = pytest.importorskip("public_tokenizers")
from riskloom.llm import alignment, chunks, line_dedup, resample  # noqa: E402

BASE = "/root/testdata/sf0.001"
BYTES, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
AWKWARD = ["", None, " ", "  ", "\n", "a", " lead", "tail ", "two  spaces   here ", "a\tb\r\nc \n d", "x\0y z", "\0",
           "<|endoftext|> a<|endoftext|>b <s> </s> <unk> <0x41>", "ä ä́ ́x ﬁ", "日本 語　x   y", "▁x ▁", "a▁b",
           "😀 😀 x 𝔘", "it's we'll 'S", "İstanbul ΣΑΣ ǅ ß", "1234 5 ² ¼", "...a,b;c! ?", "a" * 700, "=" * 300 + " " * 50,
           "word " * 400, "  \x85 \xa0 d"]
DOCS = "doc_id long, text string, n_links string, place long"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", 7) for i, t in enumerate(texts)], DOCS)


def documents():
    t = pq.read_table(f"{BASE}/documents.parquet", columns=["doc_id", "text"])
    return t.column("doc_id").to_pylist(), t.column("text").to_pylist()


# --- lines ---

def plain_lines(rows, shortest=20, fewest=3):
    def key(line):
        bare = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest:
                holders[key(line)].add(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= fewest
                                         and max(holders[key(x)]) != (-1 if doc is None else doc))]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def kept_lines(spark, texts, ids=None, **more):
    got = line_dedup.drop_repeated_lines(table(spark, texts, ids), **more)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


LONG = "A line that is long enough"


def test_lines_on_awkward_tables(spark):
    texts = [None, "", "\n", LONG, f"\t {LONG.upper()}\x0b\nx", f"{LONG}\nmine\n{LONG}  ", f"{LONG}\n\n", "İ" * 20, "İ" * 20,
             "i̇" * 20, "É" * 19, "É" * 19, "É" * 19, "Ä" * 25 + "B", "Ä" * 25 + "b", " " + "Ä" * 25 + "b ",
             "ä" * 25 + "b", " " + LONG, f"{LONG} " * 3, " " * 40, " " * 40, " " * 40]
    assert kept_lines(spark, texts) == plain_lines(list(enumerate(texts)))
    # Repeated rows are one document, a null id is the smallest, ids below zero are ids.
    ids = [5, 5, None, None, -3, 5, None]
    texts = [LONG, LONG, LONG, f"{LONG}\nb", f"{LONG}\nc", f"{LONG}\nd", None]
    want = [(5, LONG, 1, 0), (5, LONG, 1, 0), (None, "", 1, 1), (None, "b", 2, 1), (-3, "c", 2, 1),
            (5, f"{LONG}\nd", 2, 0), (None, "", 1, 0)]
    assert kept_lines(spark, texts, ids) == sorted(want, key=repr)
    assert kept_lines(spark, texts[:2], ids[:2]) == sorted(want[:2], key=repr)
    assert kept_lines(spark, []) == []


def test_lines_at_random_whatever_is_broadcast(spark):
    random.seed(11)
    lines = [f"{'Line' if i % 2 else 'line'} number {i // 3:03d} of the many" for i in range(90)]
    texts = ["\n".join(random.choices(lines, [1 / (i + 1) for i in range(90)], k=random.randint(0, 12)))
             for _ in range(200)]
    want = plain_lines(list(enumerate(texts)), fewest=4)
    for shares in (1, 20, 1_000):
        assert kept_lines(spark, texts, fewest=4, shares=shares) == want


def test_a_very_long_text_keeps_its_other_lines(spark):
    own = [f"a line of its own, number {i}" for i in range(60_000)]
    texts = ["\n".join(x for i in own for x in (i, LONG)), LONG, LONG]
    assert kept_lines(spark, texts)[0][1:] == ("\n".join(own), 120_000, 60_000)


def test_line_plan_has_no_python(spark):
    plan = line_dedup.drop_repeated_lines(table(spark, [LONG] * 3))
    text = plan._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|InPandas", text) and "CartesianProduct" not in text


# --- two tokenizers ---

def plain_alignment(rows):
    import sentencepiece
    first = chunks.open_tokenizer(open(BYTES, encoding="utf-8").read())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = {chr(v): k for k, v in chunks.byte_letters().items()}
    def spell_a(i):
        return bytes(letters[c] for c in first.id_to_token(i))
    def spell_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()
    found = []
    for doc, text in rows:
        whole = " " + (text or "")
        a = first.encode(whole, add_special_tokens=False).ids
        b = second.encode(text or "")
        if not text or b"".join(map(spell_a, a)) != whole.encode() or b"".join(map(spell_b, b)) != whole.encode():
            found.append((doc, 0, 0, []))
            continue
        groups, i, j, x, y, g, h = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                g.append(a[i]), (x := x + len(spell_a(a[i]))), (i := i + 1)
            else:
                h.append(b[j]), (y := y + len(spell_b(b[j]))), (j := j + 1)
            if x == y:
                groups.append((g, h))
                g, h = [], []
        found.append((doc, len(a), len(b), groups))
    links = [Counter((p, q) for g, h in groups for p in g for q in h) for *_, groups in found]
    counts, best = Counter(pair for held in links for pair in held), Counter()
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for (doc, n_a, n_b, groups), held in zip(found, links, strict=True):
        spelled = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc, n_a, n_b, len(groups), sum(held.values()),
                    sum(m for pair, m in held.items() if counts[pair] == best[pair[0]]),
                    sum(m * counts[pair] for pair, m in held.items()),
                    hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def aligned(spark, texts, ids=None, **more):
    got = alignment.align_tokenizers(table(spark, texts, ids), BYTES, PIECES, **more)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def test_alignment_query_equals_the_libraries(spark):
    got = sorted([tuple(r) for r in entry.queries()["op12_alignment"](spark, BASE).collect()], key=repr)
    assert got == plain_alignment(list(zip(*documents(), strict=True)))


def test_alignment_on_awkward_texts(spark):
    random.seed(5)
    texts = AWKWARD + ["".join(random.choice("aabbcde'sthe  \n.,!?01ÀéßµΣ日😀́\t<|▁") for _ in range(random.randint(0, 60)))
                       for _ in range(400)]
    want = plain_alignment(list(enumerate(texts)))
    assert aligned(spark, texts) == want
    # Few pairs broadcast, texts in small parts: the same rows.
    assert aligned(spark, texts, known=40, limit=64) == want
    assert aligned(spark, texts, known=0, limit=1_000) == want
    ids = [None, 3, 3]
    assert aligned(spark, ["a b", "a b", "c"], ids) == plain_alignment(list(zip(ids, ["a b", "a b", "c"], strict=True)))
    assert aligned(spark, []) == []


def test_links_in_blocks_and_groups_of_very_many_links():
    files = open(BYTES, encoding="utf-8").read(), open(PIECES, "rb").read()
    texts = pa.array([t for t in AWKWARD if t] + ["𝔘" * 50 + "😀" * 9])
    want = alignment.Aligner(*files).align(texts)["pairs"].to_pylist()
    for links in (1, 3, 50):
        got = alignment.Aligner(*files, links=links).align(texts)["pairs"].to_pylist()
        assert sorted(map(str, got)) == sorted(map(str, want))
        assert [r["doc"] for r in got] == sorted(r["doc"] for r in got)


def test_long_texts_are_cut_where_no_token_reaches_over():
    text = "Some words, and  more\nwords: here or there. " * 500
    parts = list(alignment.text_parts(text, 100))
    assert len(parts) > 100 and " ".join(parts) == text
    assert list(alignment.text_parts("x" * 500, 100)) == ["x" * 500]


# --- resampling ---

def plain_resample(rows, target, run=1, buckets=10_000, fewest=20, percent=10):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i:i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(x.encode()) % buckets for x in runs]
    held = [(doc, *features(text)) for doc, text in rows]
    source = Counter(b for *_, f in held for b in f)
    goal = Counter(b for text in target for b in features(text)[1])
    s, t = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1.0) * (s + buckets) / ((source[b] + 1.0) * (t + buckets))))
            for b in range(buckets)]
    out, able = [], []
    for doc, words, found in held:
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        row = [doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if words >= fewest:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, row in enumerate(able[:len(able) * percent // 100]):
        row[4] = i + 1
    return sorted(map(tuple, out), key=repr)


def resampled(spark, texts, target, ids=None, **more):
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resample.resample(table(spark, texts, ids), aims, **more)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


@pytest.mark.parametrize("run", [1, 2, 4])
def test_resampling_of_awkward_and_random_texts(spark, run):
    random.seed(run)
    vocabulary = ["a", "The", "the", "ÀB", "日本", "x1", "2", "longer" * 20, "é", "of", "😀"]
    texts = AWKWARD + [random.choice([" ", ", ", "\n", "-"]).join(random.choices(vocabulary, k=random.randint(0, 50)))
                       for _ in range(300)]
    target = ["the of the x1", None, "", "日本 2 2 2 of"] + texts[40:50]
    more = {"run": run, "buckets": 50, "percent": 30}
    assert resampled(spark, texts, target, **more) == plain_resample(list(enumerate(texts)), target, **more)


def test_resampling_without_rows_keys_or_target(spark):
    texts = ["a b c " * 10, "a b c " * 10, "b " * 30, "short", None, "b " * 30]
    ids = [4, 4, None, 9, 1, 2]
    rows = list(zip(ids, texts, strict=True))
    assert resampled(spark, texts, [], ids, percent=60) == plain_resample(rows, [], percent=60)
    assert resampled(spark, texts, ["b"], ids, percent=100) == plain_resample(rows, ["b"], percent=100)
    assert resampled(spark, [], ["b"]) == []


@pytest.mark.parametrize("run", [1, 3])
def test_small_windows_and_dictionaries_change_nothing(run):
    texts = pa.array([t for t in AWKWARD if t is None or len(t) < 5_000] * 2 + ["x" * 300 + " y z"])
    def found(**more):
        return sorted((int(t), int(b)) for text, bucket, _ in resample.Features(run, 997, **more).of(texts)
                      for t, b in zip(text, bucket, strict=True))
    want = found()
    for more in ({"window": 8}, {"window": 50, "most": 5}, {"most": 0}):
        assert found(**more) == want
    again = resample.Features(run, 997)
    for _ in range(3):  # words known by now come from the automaton
        got = sorted((int(t), int(b)) for text, bucket, _ in again.of(texts) for t, b in zip(text, bucket, strict=True))
        assert got == want


def test_crc_of_joined_runs():
    random.seed(3)
    shift = resample.Shift()
    pairs = [(random.randbytes(random.randint(0, 9)), random.randbytes(random.choice([0, 1, 7, 300, 70_000])))
             for _ in range(50)]
    got = shift.join(*(resample.np.array(x) for x in zip(*[(zlib.crc32(a), zlib.crc32(b), len(b)) for a, b in pairs])))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
