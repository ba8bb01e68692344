"""Language of a text by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of one fixed public vocabulary. The probability of
a word is the sum, over all ways to cut it into pieces, of the product of their probabilities; a
forward pass gives it exactly, for all words of one length at once. A text scores the sum of its
words' logarithms. The probabilities come from expectation maximisation over word counts of a
bounded sample, with the same forward pass and its backward twin.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import chunks
from riskloom.llm.quality import held_out

START = "▁"
LONGEST_PIECE = 12
LONGEST_WORD = 32
DOCS = 1_500
WORDS = 30_000
ROUNDS = 4
# Shares of a language that are ranked on their own; each may give twice its part of the sample.
SHARES = 50
SMOOTH = 0.01
UNKNOWN = 1e-8
SURE = 0.5
SEED = 7

_STEP = np.uint64(0x9E3779B97F4A7C15)


def public_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters of a sentencepiece model, the word start among them."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or len(piece) > LONGEST_PIECE:
            continue
        plain = piece.removeprefix(START)
        if piece == START or plain.isalpha() and plain == plain.lower():
            out.append(piece)
    return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of letters and marks, and per text where its words start."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    plain = pc.replace_substring_regex(low, r"[^\p{L}\p{M}]+", " ")
    parts = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    offsets = parts.offsets.to_numpy()
    return parts.flatten(), np.asarray(offsets, np.int64) - int(offsets[0])


def hashes(code: np.ndarray) -> list[np.ndarray]:
    """For words as rows of code points: hashes of all substrings of n = 1, 2, ... code points."""
    with np.errstate(over="ignore"):
        code = code.astype(np.uint64) + np.uint64(1)
        now, out = code, [code * _STEP]
        for n in range(2, min(LONGEST_PIECE, code.shape[1]) + 1):
            now = now[:, :-1] * np.uint64(0x100000001B3) + code[:, n - 1:]
            out.append((now + np.uint64(n)) * _STEP)
        return [h ^ (h >> np.uint64(31)) for h in out]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    pieces: list[str]
    chance: np.ndarray  # a row per piece and one for unknown letters, a column per language

    def __post_init__(self):
        self._known = None

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        """Piece number of each hash; the number of pieces where there is none."""
        if self._known is None:
            own = np.array([hashes(as_codes([p]))[-1][0, 0] for p in self.pieces], np.uint64)
            first, second = np.full(1 << 20, -1, np.int32), np.full(1 << 20, -1, np.int32)
            lost = []
            for i, h in enumerate(own):
                for table, shift in ((first, 44), (second, 22)):
                    slot = int(h >> np.uint64(shift)) & 0xFFFFF
                    if table[slot] < 0:
                        table[slot] = i
                        break
                else:
                    lost.append(i)
            self._known = (np.append(own, np.uint64(0)), first, second, lost)
        own, first, second, lost = self._known
        out = np.full(hashed.shape, len(self.pieces), np.int64)
        for table, shift in ((first, 44), (second, 22)):
            guess = table[(hashed >> np.uint64(shift)).astype(np.int64) & 0xFFFFF]
            hit = own[guess] == hashed
            out[hit & (guess >= 0)] = guess[hit & (guess >= 0)]
        for i in lost:
            out[hashed == own[i]] = i
        return out


def as_codes(words: Sequence[str]) -> np.ndarray:
    """Code points of words of one length as rows."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return raw.reshape(len(words), -1)


def forward(model: Model, code: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """alpha[j]: summed probability of all segmentations of the first j letters; and the piece numbers."""
    words, letters = code.shape
    numbers = [model.numbers(h) for h in hashes(code)]
    alpha = np.zeros((letters + 1, words, len(model.languages)))
    alpha[0] = 1
    none = len(model.pieces)
    for j in range(1, letters + 1):
        for n in range(1, min(j, LONGEST_PIECE) + 1):
            piece = numbers[n - 1][:, j - n]
            if n == 1:
                alpha[j] += alpha[j - 1] * model.chance[piece]
            else:
                there = np.flatnonzero(piece != none)
                if len(there):
                    alpha[j, there] += alpha[j - n, there] * model.chance[piece[there]]
    return alpha, numbers


def long_word(model: Model, word: str) -> np.ndarray:
    """Log probability of one long word, rescaled at every letter."""
    code = as_codes([word])
    numbers = [model.numbers(h)[0] for h in hashes(code)]
    none, letters = len(model.pieces), code.shape[1]
    alpha = np.zeros((LONGEST_PIECE, len(model.languages)))  # a ring of the last letters
    alpha[0] = 1
    scale = np.zeros(len(model.languages))
    for j in range(1, letters + 1):
        now = np.zeros(len(model.languages))
        for n in range(1, min(j, LONGEST_PIECE) + 1):
            piece = numbers[n - 1][j - n]
            if n == 1 or piece != none:
                now += alpha[(j - n) % LONGEST_PIECE] * model.chance[piece]
        alpha[j % LONGEST_PIECE] = now
        if j % 8 == 0:
            top = alpha.max(axis=0)
            alpha /= top
            scale += np.log(top)
    return scale + np.log(alpha[letters % LONGEST_PIECE])


def by_length(words: Sequence[str]) -> dict[int, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    return {int(sizes[order[a]]): part for a, part in zip(edges, np.split(order, edges[1:]), strict=False)} \
        if len(words) else {}


def word_scores(model: Model, words: Sequence[str], step: int = 50_000) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), len(model.languages)))
    for size, rows in by_length(words).items():
        if size == 0:
            continue
        if size > LONGEST_WORD:
            for i in rows:
                out[i] = long_word(model, START + words[i])
            continue
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            alpha, _ = forward(model, as_codes([START + words[i] for i in part]))
            out[part] = np.log(alpha[-1])
    return out


def learn(counts: dict[str, list[tuple[str, int]]], prior: dict[str, int], pieces: list[str],
          rounds: int = ROUNDS) -> Model:
    """Expectation maximisation per language over its word counts."""
    languages = sorted(counts)
    total = sum(prior.values())
    share = np.array([prior[x] / total for x in languages]) if total else np.zeros(0)
    chance = np.full((len(pieces) + 1, len(languages)), 1 / max(1, len(pieces)))
    chance[-1] = UNKNOWN
    for column, language in enumerate(languages):
        # A short word weighs by its count; words over the longest are left to smoothing.
        rows = [(w, n) for w, n in counts[language] if 0 < len(w) <= LONGEST_WORD]
        words, times = [w for w, _ in rows], np.array([n for _, n in rows], float)
        groups = by_length(words)
        one = Model([language], np.ones(1), pieces, chance[:, column:column + 1].copy())
        for _ in range(rounds):
            expected = np.zeros(len(pieces) + 1)
            for part in groups.values():
                expected += _expected(one, as_codes([START + words[i] for i in part]), times[part])
            fresh = expected[:-1] + SMOOTH
            one.chance[:-1, 0] = fresh / fresh.sum()
        chance[:, column] = one.chance[:, 0]
    return Model(languages, share, pieces, chance)


def _expected(model: Model, code: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, over all segmentations of the words."""
    alpha, numbers = forward(model, code)
    words, letters = code.shape
    none = len(model.pieces)
    beta = np.zeros((letters + 1, words))
    beta[letters] = 1
    out = np.zeros(none + 1)
    weight = times / alpha[letters, :, 0]
    for j in range(letters, 0, -1):
        for n in range(1, min(j, LONGEST_PIECE) + 1):
            piece = numbers[n - 1][:, j - n]
            used = piece != none if n > 1 else np.ones(words, bool)
            through = np.where(used, model.chance[piece, 0] * beta[j], 0)
            beta[j - n] += through
            out += np.bincount(piece, through * alpha[j - n, :, 0] * weight, none + 1)
    return out


def fit(docs: DataFrame, pieces_path: str, key: str = "doc_id", text: str = "text", lang: str = "lang",
        docs_per_language: int = DOCS, words_per_language: int = WORDS) -> Model:
    """Learn from the rows with a language that are not held out.

    Priors count all of them. Of each language at most `docs_per_language` rows, those with the smallest hashes, are
    read, and of their words the `words_per_language` commonest count; both bounds are parameters
    of the fit only. The driver sees these word counts. Rows without key or language teach nothing.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(lang).cast("string").alias("lang"),
                       F.col(text).alias("text"))
    rows = rows.where(F.col("key").isNotNull() & F.col("lang").isNotNull() & ~held_out("key"))
    prior = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # Ranked within shares first, so that a common language isn't one task.
    order = [F.xxhash64("key", F.lit(SEED)), "key"]
    shared = Window.partitionBy("lang", "_share").orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    chosen = (rows.select("key", "lang", F.pmod(F.xxhash64("key"), F.lit(SHARES)).alias("_share")).distinct()
              .withColumn("_rank", F.row_number().over(shared)).where(F.col("_rank") <= -(-2 * docs_per_language // SHARES))
              .withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= docs_per_language)
              .select("key", "lang"))

    def count(batches):
        for batch in batches:
            for at, part in chunks.slices(batch.column(1), chunks.WORK_BYTES):
                flat, starts = words_of(part)
                if not len(flat):
                    continue
                word, index = chunks.distinct(flat)
                lang_of = batch.column(0).slice(at, len(part)).dictionary_encode()
                owner = np.repeat(lang_of.indices.to_numpy(), np.diff(starts))
                both, n = np.unique(owner.astype(np.int64) * len(word) + index, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [lang_of.dictionary.take(pa.array(both // len(word))),
                     pa.array(word, pa.string()).take(pa.array(both % len(word))), pa.array(n, pa.int64())],
                    names=["lang", "word", "n"])

    sample = rows.join(F.broadcast(chosen), ["key", "lang"]).select("lang", "text")
    common = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counted = (sample.mapInArrow(chunks.tidied(count), "lang string, word string, n bigint").where("word != ''")
               .groupBy("lang", "word").agg(F.sum("n").alias("n"))
               .withColumn("_rank", F.row_number().over(common))
               .where(F.col("_rank") <= words_per_language).select("lang", "word", "n"))
    counts: dict[str, list[tuple[str, int]]] = {x: [] for x in prior}
    for r in counted.collect():
        counts[r["lang"]].append((r["word"], r["n"]))
    for words in counts.values():
        words.sort()
    return learn(counts, prior, public_pieces(pieces_path))


def judge(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: number of the likeliest language, its probability, and whether there is any letter."""
    flat, starts = words_of(texts)
    words, index = chunks.distinct(flat)
    scores = word_scores(model, words)
    lettered = np.array([any(map(str.isalpha, w)) for w in words], bool) if words else np.zeros(0, bool)
    seen = np.concatenate([[0], np.cumsum(lettered[index])]) if words else np.zeros(1, np.int64)
    logs = np.empty((len(texts), len(model.languages)))
    for k in range(len(model.languages)):
        ends = np.concatenate([[0.0], np.cumsum(scores[index, k])])
        logs[:, k] = ends[starts[1:]] - ends[starts[:-1]] + np.log(model.prior[k])
    best = logs.argmax(axis=1)
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    sure = 1 / odds.sum(axis=1)
    return best, sure, seen[starts[1:]] > seen[starts[:-1]]


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
             columns: tuple[str, ...] = ()) -> DataFrame:
    """(columns, key, held_out, lang_pred, score) per row, from the whole text alone.

    Null text and text without a letter: `und` with score 0, as for all texts if no language was learned.
    Null keys and repeated rows stay; ties go to the language first in the alphabet; an empty
    table gives no rows. The model's size depends on vocabulary and languages only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = shared.value
        names = [*model.languages, "und"]
        for batch in batches:
            for at, part in chunks.slices(batch.column(batch.num_columns - 1), chunks.WORK_BYTES):
                if model.languages:
                    best, sure, lettered = judge(model, part)
                else:
                    best, sure, lettered = (np.zeros(len(part), t) for t in (int, float, bool))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(part)) for i in range(batch.num_columns - 1)),
                     pa.array([names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], pa.string()),
                     pa.array(np.where(lettered, np.clip(sure, 0, 1), 0.0), pa.float64())],
                    names=[*batch.schema.names[:-1], "_lang", "_score"])

    passed = [F.col(c) for c in columns]
    rows = docs.select(*passed, F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    found = rows.mapInArrow(chunks.tidied(predict), f"{kinds}, _lang string, _score double")
    return found.select(*passed, F.col("_key").alias(key) if key not in columns else F.col("_key"),
                        held_out("_key").alias("held_out"), F.col("_lang").alias("lang_pred"),
                        F.col("_score").alias("score"))


def keep_known(docs: DataFrame, pieces_path: str, sure: float = SURE, key: str = "doc_id",
               text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs`, with their columns, whose text is surely in one of the learned languages."""
    marked = docs.withColumnsRenamed({c: f"in_{i}" for i, c in enumerate(docs.columns)})
    name = dict(zip(docs.columns, marked.columns, strict=True))
    found = identify(marked, fit(docs, pieces_path, key, text, lang), name[key], name[text],
                     tuple(marked.columns))
    return (found.where((F.col("lang_pred") != "und") & (F.col("score") >= sure))
            .select(*(F.col(name[c]).alias(c) for c in docs.columns)))
