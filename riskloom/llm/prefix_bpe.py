"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The merges of a word are never replayed. For every prefix of a word there is exactly one token
its encoding can end with. Tokens that end at a place come from an automaton over the
vocabulary with suffix links (all matches in one pass). A match is the last token if what
stands before it is empty, or if it is *compatible* with the last token of the shorter prefix:
the two stay apart when their texts are merged side by side. Following the last tokens back
from the end gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import chunks

# Stands for the end of a word in the automaton; no byte letter looks like it.
_END = ""
PAIRS_KEPT = 1_000_000


class PrefixBPE:
    """Words (as byte letters) to ids, for a BPE vocabulary that has a token for every byte."""

    def __init__(self, model: dict):
        import ahocorasick
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE is supported")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.ends = bool(suffix)
        letters = [chr(c) for c in chunks.byte_letters().values()]
        missing = [x for x in letters for y in {x, x + suffix} if y not in vocab]
        if missing:
            raise ValueError(f"no token for {missing[:3]}")
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), rank)
            if new in self.made:
                raise ValueError(f"two merges make {a + b!r}")
            self.made[new] = (left, right, rank)
        self.apart: dict[tuple[int, int], bool] = {}
        self.rights: dict[int, list[tuple[int, float]]] = {}
        self.lefts: dict[int, list[tuple[int, float]]] = {}
        single = {vocab[x] for c in letters for x in {c, c + suffix}}
        self.matches = ahocorasick.Automaton()
        for token, id_ in vocab.items():
            if id_ not in single and (id_ not in self.made or not self._whole(id_)):
                continue  # never an outcome of merging
            ended = self.ends and token.endswith(suffix)
            form = token[: -len(suffix)] if ended else token
            self.matches.add_word(form + _END * ended, (id_, len(form), ended))
        self.matches.make_automaton()

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at one edge of a token while it grows, each with the rank of its next merge."""
        kept = (self.lefts, self.rights)[side]
        if token not in kept:
            spine, until = [(token, float("inf"))], token
            while until in self.made:
                left, right, rank = self.made[until]
                until = (left, right)[side]
                spine.append((until, rank))
            kept[token] = spine
        return kept[token]

    def compatible(self, first: int, second: int, before: float = float("inf")) -> bool:
        """No merge joins the two across their border (looking only at merges of rank under `before`).

        A crossing merge happens if its rank comes before the next merge of its left part, and not
        after that of its right part: of equal ranks, the one further left is done first.
        """
        known = self.apart.get((first, second)) if before == float("inf") else None
        if known is not None:
            return known
        result = True
        for a, a_until in self._spine(first, 1):
            for b, b_until in self._spine(second, 0):
                rank = self.rank.get((a, b))
                if rank is not None and rank < before and rank < a_until and rank <= b_until:
                    result = False
        if before == float("inf"):
            if len(self.apart) >= PAIRS_KEPT:
                self.apart.clear()
            self.apart[first, second] = result
        return result

    def _whole(self, token: int) -> bool:
        """Merging the token's own text ends with this one token."""
        left, right, rank = self.made[token]
        return (self.compatible(left, right, rank)
                and all(x not in self.made or self._whole(x) for x in (left, right)))

    def encode(self, word: str) -> list[int]:
        n = len(word)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for end, (token, size, ended) in self.matches.iter(word + _END if self.ends else word):
            stop = end if ended else end + 1
            if stop > n or (self.ends and ended != (stop == n)) or last[stop] is not None:
                continue
            begin = stop - size
            if begin == 0:
                last[stop] = (token, 0)
            else:
                before = last[begin]
                if before is not None and self.compatible(before[0], token):
                    last[stop] = (token, begin)
        ids, at = [], n
        while at:
            step = last[at]
            if step is None:
                raise ValueError(f"{word!r} cannot be encoded")
            ids.append(step[0])
            at = step[1]
        return ids[::-1]


class TextCoder:
    """Whole texts to ids by `PrefixBPE`, and ids to text as the tokenizers library decodes."""

    def __init__(self, spec: str, keep: int = 300_000):
        plan = json.loads(spec)
        self.tokenizer = chunks.open_tokenizer(spec)
        self.bpe = PrefixBPE(plan["model"])
        self.words = chunks.Words(spec, self.tokenizer)
        self.special = {t["content"]: t["id"] for t in plan.get("added_tokens", [])}
        if any(t.get("normalized") for t in plan.get("added_tokens", [])):
            raise ValueError("normalized added tokens are not supported")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if longest_first else None
        self.names = {i: t for t, i in plan["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.joined = plan.get("decoder") is None  # then the library puts spaces between tokens
        self.bytewise = (plan.get("decoder") or {}).get("type") == "ByteLevel"
        self.parts = chunks.Remembered(lambda words: [self.bpe.encode(w) for w in words], keep)
        self.memory = chunks.Remembered(self._chunks, keep)

    def _cut(self, chunk: str) -> list:
        """Words as byte letters; ids of special strings."""
        found = self.words.short(chunk)
        if found is not None:
            return found
        out: list = []
        for piece in self.cut(chunk) if self.cut else [chunk]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                normal = self.tokenizer.normalizer
                plain = normal.normalize_str(piece) if normal else piece
                out += [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def _chunks(self, texts: Sequence[str]) -> list[tuple[int, bytes, bytes]]:
        cuts = [self._cut(t) for t in texts]
        part = self.parts.table([w for words in cuts for w in words if isinstance(w, str)])
        out = []
        for words in cuts:
            ids = [i for w in words for i in (part[w] if isinstance(w, str) else (w,))]
            names = "".join([self.names[i] + " " for i in ids]) if self.joined else ""
            out.append((len(ids), "".join([f"{i} " for i in ids]).encode(), names.encode()))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        if self.joined:
            return " ".join(self.names[i] for i in ids)
        if self.bytewise and not set(ids) & set(self.special.values()):
            letters = {v: k for k, v in chunks.byte_letters().items()}
            return bytes(letters[ord(c)] for i in ids for c in self.names[i]).decode("utf-8", "replace")
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)

    def encode(self, texts: pa.Array) -> list[tuple[int, bytes, bytes]]:
        """Per text: number of ids, ids as decimal numbers, decoded text (UTF-8)."""
        flat, starts = chunks.cut(texts)
        unique, index = chunks.distinct(flat)
        values = self.memory.of(unique)
        counts, numbers, names = ([v[k] for v in values] for k in range(3))
        edges, index = starts.tolist(), index.tolist()
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            row = index[a:b]
            written = b"".join([numbers[i] for i in row])[:-1]
            decoded = (b"".join([names[i] for i in row])[:-1] if self.joined
                       else self.decode([int(x) for x in written.split()]).encode())
            out.append((sum([counts[i] for i in row]), written, decoded))
        return out


def _coded(docs: DataFrame, tokenizer_path: str, key: str, text: str, rows, schema: str) -> DataFrame:
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def code(batches):
        coder = chunks.opened(TextCoder, spec.value)
        for batch in batches:
            for at, part in chunks.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), *rows(coder.encode(part))],
                    names=["key", *(x.split()[0] for x in schema.split(", "))])

    plain = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return plain.mapInArrow(code, f"key bigint, {schema}").withColumnRenamed("key", key)


def encode_texts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string) of every whole text.

    Ids equal those of the tokenizers library without added special tokens, padding or
    truncation; special strings inside a text become their ids. Null text is empty (no ids,
    empty text); null keys and repeated rows stay; an empty table gives no rows; other columns
    are not read.
    """
    def rows(coded):
        return [pa.array([[int(x) for x in c[1].split()] for c in coded], pa.list_(pa.int32())),
                pa.array([c[2].decode() for c in coded], pa.string())]
    return _coded(docs, tokenizer_path, key, text, rows, "ids array<int>, decoded string")


def digest_texts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As `encode_texts`, but per text only n_tokens and SHA-256 of the written ids and of the decoded text."""
    def rows(coded):
        sha = hashlib.sha256
        return [pa.array(np.array([c[0] for c in coded], np.int64)),
                pa.array([sha(c[1]).hexdigest() for c in coded], pa.string()),
                pa.array([sha(c[2]).hexdigest() for c in coded], pa.string())]
    return _coded(docs, tokenizer_path, key, text, rows,
                  "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
