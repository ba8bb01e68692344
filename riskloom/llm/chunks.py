"""Exact tokenization of whole texts through a bounded memory of encoded chunks.

A text is cut at *safe boundaries*: before a single space or line feed that stands between two
characters which are white space in no version of Unicode. Neither the byte-level pattern nor
the word pattern of the public BPE files lets a token cross such a place, and special strings
hold no white space, so the ids of a text are the ids of its chunks in a row. Each distinct chunk
of a batch is looked up once; only chunks not seen lately go to the tokenizer, in batches
balanced by bytes. Texts of any length therefore become many small pieces of work, and memory
depends on the batch and on `keep`, not on the longest text.
"""

from __future__ import annotations

import ctypes
import gc
import json
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters next to which a cut is allowed: no control character, no white space.
_SAFE = "!-~\u00a1-\u167f\u3001-\ud7ff"
_UNSAFE = f"[^{_SAFE}][ \\n]|[ \\n][^{_SAFE}]|^[ \\n]|[ \\n]$|\\x00"
_CUT = f"([{_SAFE}])([ \\n])([{_SAFE}])"
# Bytes of text handled at once, and bytes given to the tokenizer at once.
SLICE_BYTES = 8 << 20
# Chunks whose ids are gathered at once.
GATHERED = 1 << 17
# The same where several numbers of eight bytes are kept for every letter.
WORK_BYTES = 4 << 20
BATCH_BYTES = 1 << 18
LONGEST_KEPT, KEPT = 64, 300_000


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about `limit` bytes (a longer text is a run of its own), with their start."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, column.slice(at, stop - at)
        at = stop


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all texts (null: none) and, per text, where its chunks start (one more at the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    awkward = pc.match_substring_regex(texts, _UNSAFE)
    plain = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
    if pc.any(awkward).as_py():
        # A boundary that shares a character with the one before may stay uncut: a longer chunk.
        some = pc.replace_substring_regex(texts.filter(awkward), _CUT, "\\1\0\\2\\3")
        plain = pc.replace_with_mask(plain, awkward, some)
    parts = pc.split_pattern(plain, "\0")
    holed = pc.match_substring(texts, "\0")
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    if pc.any(holed).as_py():  # a text with the mark itself is one chunk
        lists = [[t] if h else p for t, h, p in
                 zip(texts.to_pylist(), holed.to_pylist(), parts.to_pylist(), strict=True)]
        flat = pa.array([x for p in lists for x in p], pa.large_string())
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in lists])])
    return flat, np.asarray(offsets, np.int64) - int(offsets[0])


def byte_batches(chunks: Sequence[str], limit: int = BATCH_BYTES) -> Iterator[Sequence[str]]:
    at, size = 0, 0
    for i, chunk in enumerate(chunks):
        size += 4 * len(chunk) + 32
        if size >= limit:
            yield chunks[at:i + 1]
            at, size = i + 1, 0
    if at < len(chunks):
        yield chunks[at:]


class Remembered:
    """value of each distinct chunk, remembered in two generations of at most `keep` chunks."""

    def __init__(self, values: Callable[[Sequence[str]], list], keep: int = 250_000):
        self.values, self.keep = values, keep
        self.young: dict = {}
        self.old: dict = {}

    def of(self, chunks: list[str]) -> list:
        young, old = self.young, self.old
        found = [young.get(c) for c in chunks]
        misses = []
        for i, value in enumerate(found):
            if value is None:
                value = old.get(chunks[i])
                if value is None:
                    misses.append(i)
                else:
                    found[i] = young[chunks[i]] = value
        wanted = [chunks[i] for i in misses]
        at = 0
        for batch in byte_batches(wanted):
            for chunk, value in zip(batch, self.values(batch), strict=True):
                found[misses[at]] = value
                at += 1
                if len(chunk) <= LONGEST_KEPT:
                    young[chunk] = value
        if len(young) > self.keep:
            self.old, self.young = young, {}
        return found

    def table(self, chunks: Sequence[str]) -> dict:
        """The value of every chunk as a table; chunks may repeat."""
        unique = list(dict.fromkeys(chunks))
        return dict(zip(unique, self.of(unique), strict=True))


def distinct(flat: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def open_tokenizer(spec: str):
    """The tokenizer of a JSON document, as the library opens it, without padding or truncation."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


# The two word patterns of the public files and how they treat case, written for
# characters up to U+024F, whose classes no version of Unicode has changed.
_L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTEWISE = rf"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^ \n{_L}{_N}]+|[ \n]+(?![^ \n])|[ \n]+"
BYTE_WORDS = re.compile(_BYTEWISE)
# The same for ASCII whose space and line feed already are byte letters.
LETTER_WORDS = re.compile(rf"{_SHORT}|Ġ?[A-Za-z]+|Ġ?[0-9]+|Ġ?[^ĠĊA-Za-z0-9]+|[ĠĊ]+(?![^ĠĊ])|[ĠĊ]+")
LOWER_WORDS = re.compile(rf"{_SHORT}|[{_L}]+|[{_N}]|[^ \n{_L}{_N}]+")
# Both for many ASCII chunks at once, a zero byte between two of them being a word of its own.
MANY_LETTER_WORDS = re.compile(
    rf"\0|{_SHORT}|Ġ?[A-Za-z]+|Ġ?[0-9]+|Ġ?[^ĠĊA-Za-z0-9\0]+|[ĠĊ]+(?![^ĠĊ\0])|[ĠĊ]+")
MANY_LOWER_WORDS = re.compile(rf"\0|{_SHORT}|[a-z]+|[0-9]|[^ \na-z0-9\0]+")
_MANY_COMMON = re.compile("[ -~\n\0]*").fullmatch
_COMMON = re.compile("[ -~\n\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]*").fullmatch


def byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = byte_letters()


def as_letters(word: str) -> str:
    return word.encode().decode("latin-1").translate(_LETTERS)


class Words:
    """Cut chunks into the words that a tokenizer merges on their own."""

    def __init__(self, spec: str, tokenizer):
        """`spec`: the JSON document of `tokenizer`; only the two known patterns have a short way."""
        self.tokenizer = tokenizer
        plan = json.loads(spec)
        normal, before = plan.get("normalizer"), plan.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in (normal or {}).get("normalizers", [])]
        inner = [x.get("type") for x in before.get("pretokenizers", [])]
        plain = not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word")
                        for t in plan.get("added_tokens", []))
        self.lower = plain and steps == ["NFC", "Replace", "Lowercase"] and inner == ["Split", "ByteLevel"]
        bytewise = (plain and normal is None and before.get("type") == "ByteLevel"
                    and before.get("use_regex") and not before.get("add_prefix_space"))
        self.find = LOWER_WORDS.findall if self.lower else BYTE_WORDS.findall if bytewise else None
        added = [re.escape(t["content"]) for t in plan.get("added_tokens", [])]
        self.special = re.compile("|".join(added) or r"(?!)").search

    def short(self, chunk: str) -> list[str] | None:
        """The words as byte letters, or None where the library itself must cut."""
        if self.find is None or not _COMMON(chunk) or self.special(chunk):
            return None
        if chunk.isascii():  # ASCII letters and signs stand for themselves
            if self.lower:
                return self.find(chunk.lower())
            return LETTER_WORDS.findall(chunk.replace(" ", "Ġ").replace("\n", "Ċ"))
        return [as_letters(w) for w in self.find(chunk.lower() if self.lower else chunk)]

    def many(self, chunks: Sequence[str]) -> list[str] | None:
        """The words of all chunks with "\\0" between two chunks, or None where `short` must look at each."""
        joined = "\0".join(chunks)
        if (self.find is None or joined.count("\0") >= len(chunks) or not _MANY_COMMON(joined)
                or self.special(joined)):
            return None
        if self.lower:
            return MANY_LOWER_WORDS.findall(joined.lower())
        return MANY_LETTER_WORDS.findall(joined.replace(" ", "Ġ").replace("\n", "Ċ"))


class _Merged:
    """What each chunk is worth, from what its words are worth; see `Encoder` and `Counter`."""

    def __init__(self, spec: str, keep: int, parts: int | None = None):
        self.tokenizer = open_tokenizer(spec)
        self.model = self.tokenizer.model
        self.words = Words(spec, self.tokenizer)
        self.most_parts, self.parts = keep // 4 if parts is None else parts, {}
        self.memory = Remembered(self._values, keep)

    def _values(self, chunks: Sequence[str]) -> list:
        if len(self.parts) > self.most_parts:
            self.parts.clear()
        # One chunk with, say, a tab would send all others the long way.
        easy = [i for i, chunk in enumerate(chunks)
                if chunk.isascii() and (chunk.isprintable() or chunk[1:].isprintable() and chunk[0] == "\n")]
        words = self.words.many([chunks[i] for i in easy]) if easy else None
        if words is None:
            return self._one_by_one(chunks)
        out: list = [None] * len(chunks)
        for i, value in zip(easy, self._many(words), strict=True):
            out[i] = value
        if len(easy) < len(chunks):
            rest = [i for i, value in enumerate(out) if value is None]
            for i, value in zip(rest, self._one_by_one([chunks[i] for i in rest]), strict=True):
                out[i] = value
        return out

    def _many(self, words: list[str]) -> list:
        parts, merged, add_up = self.parts, self._merged, self._add_up
        out, row = [], []
        for word in words:
            if word == "\0":
                out.append(row[0] if len(row) == 1 else add_up(row))
                row = []
                continue
            value = parts.get(word)
            if value is None:
                value = parts[word] = merged(word)
            row.append(value)
        out.append(row[0] if len(row) == 1 else add_up(row))
        return out

    def _one_by_one(self, chunks: Sequence[str]) -> list:
        parts, short, merged, add_up = self.parts, self.words.short, self._merged, self._add_up
        out, whole = [], []
        for chunk in chunks:
            words = short(chunk)
            if words is None:
                whole.append(len(out))
                out.append(chunk)
                continue
            row = []
            for word in words:
                value = parts.get(word)
                if value is None:
                    value = parts[word] = merged(word)
                row.append(value)
            out.append(row[0] if len(row) == 1 else add_up(row))
        if whole:
            rows = self.tokenizer.encode_batch_fast([out[i] for i in whole], add_special_tokens=False)
            for i, row in zip(whole, rows, strict=True):
                out[i] = self._read(row)
        return out


class Encoder(_Merged):
    """Whole texts to ids with the tokenizers library."""

    def __init__(self, spec: str, keep: int = KEPT, parts: int | None = None):
        super().__init__(spec, keep, parts)
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.uint32 if wide else np.uint16
        self.code = self.kind(0).dtype.char
        self._add_up = b"".join

    def _merged(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _read(self, row) -> bytes:
        return array(self.code, row.ids).tobytes()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and per text where its ids start (one more entry at the end)."""
        flat, starts = cut(texts)
        words, index = distinct(flat)
        values = self.memory.of(words)
        known = np.frombuffer(b"".join(values), self.kind)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.kind().itemsize
        begins, ends = np.cumsum(sizes) - sizes, np.concatenate([[0], np.cumsum(sizes[index])])
        ids = np.empty(ends[-1], self.kind)
        for at in range(0, len(index), GATHERED):
            some, edges = index[at:at + GATHERED], ends[at:at + GATHERED + 1]
            places = np.repeat(begins[some] - edges[:-1], np.diff(edges))
            places += np.arange(edges[0], edges[-1])
            ids[edges[0]:edges[-1]] = known[places]
        return ids, ends[starts]


def encoder(spec: tuple) -> Encoder:
    """The encoder of (JSON document, chunks remembered in each of two generations, words of chunks)."""
    return Encoder(*spec)


class Counter(_Merged):
    """Whole texts to numbers of ids with the tokenizers library."""

    def __init__(self, spec: str, keep: int = KEPT):
        super().__init__(spec, keep)
        self._add_up, self._read = sum, len

    def _merged(self, word: str) -> int:
        return len(self.model.tokenize(word))

    def counts(self, texts: pa.Array) -> np.ndarray:
        flat, starts = cut(texts)
        words, index = distinct(flat)
        sizes = np.array(self.memory.of(words), np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes[index])])
        return np.diff(ends[starts])


_OPEN: dict = {}


def forget() -> None:
    """Give back what this worker remembers and no longer uses, for work that needs the room itself."""
    _OPEN.clear()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # numbers freed between smaller ones still in use
        libc.malloc_trim(0)


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work` over batches with the worker's memory given back before and after: workers outlive their tasks."""
    def run(batches):
        forget()
        try:
            yield from work(batches)
        finally:
            forget()
    return run


def opened(kind: Callable, spec):
    """The `kind(spec)` of this Python worker: what it remembers serves all tasks until another is opened."""
    key = (kind, hash(spec))
    if key not in _OPEN:
        forget()
        gc.set_threshold(200_000, 50, 100)  # the tables hold no cycles; walking them often is waste
        _OPEN[key] = kind(spec)
    return _OPEN[key]
