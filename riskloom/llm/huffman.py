"""Canonical length-limited Huffman codes for ids, with vectorised coding and decoding.

Codes are written from the highest bit on. A file holds blocks of `block` ids; the bit offset of
every block is kept, so blocks decode independently: `decode` advances all blocks in step, one
table lookup per id.
"""

from __future__ import annotations

import numpy as np

LIMIT = 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most `limit` bits by package-merge; 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols have no codes of {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    level, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        levels.append(rank < n)
    take = 2 * n - 2
    bits = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leafs = int(is_leaf[:take].sum())
        bits[:leafs] += 1
        take = 2 * (take - leafs)
    lengths[order] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol: shorter codes first, then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    bits = lengths[order].astype(int)
    for length in np.unique(bits):
        group = order[bits == length]
        code <<= int(length) - last
        codes[group] = np.arange(code, code + len(group), dtype=np.uint64)
        code, last = code + len(group), int(length)
    return codes


# Ids coded at once; each stretch begins on a whole byte.
STRETCH = 1 << 20


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int) -> tuple[np.ndarray, list[bytes]]:
    """Bit offset of every block (and the end), and the bits, in memory bounded by STRETCH."""
    step = max(1, STRETCH // block) * block
    offsets, bits, done = [], [], 0
    for at in range(0, len(ids), step):
        own, part = _encode(ids[at:at + step], lengths, codes, block)
        offsets.append(own[:-1] + np.uint64(8 * done))
        bits.append(part)
        done += len(part)
    return np.concatenate([*offsets, np.array([8 * done], np.uint64)]), bits


def decode(bits: bytes, offsets: np.ndarray, n_ids: int, block: int, table: np.ndarray, width: int) -> np.ndarray:
    """All ids, stretch by stretch; blocks of a stretch advance together."""
    blocks = max(1, STRETCH // block)
    out = np.zeros(n_ids, np.uint32)
    for at in range(0, len(offsets) - 1, blocks):
        some = offsets[at:at + blocks + 1]
        first, last = int(some[0]) >> 3, (int(some[-1]) + 7) >> 3
        n = min(n_ids - at * block, blocks * block)
        out[at * block:at * block + n] = _decode(bits[first:last], some - np.uint64(8 * first), n, block, table, width)
    return out


def _encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int) -> tuple[np.ndarray, bytes]:
    """Bit offset of every block (and the end), and the bits."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    starts = ends - sizes
    offsets = np.append(starts[::block], total).astype(np.uint64)
    words = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        word, left = starts >> 6, 64 - (starts & 63) - sizes
        code = codes[ids]
        high = np.where(left >= 0, code << np.maximum(left, 0).astype(np.uint64),
                        code >> np.maximum(-left, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(left < 0)  # at most one code crosses into each word
        words[word[over] + 1] |= code[over] << (64 + left[over]).astype(np.uint64)
    return offsets, words.astype(">u8").tobytes()[: (total + 7) // 8]


def decoding_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbol and length (in the low 6 bits) of the code that starts each window of `width` bits."""
    width = max(1, int(lengths.max()) if len(lengths) else 1)
    table = np.zeros(1 << width, np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(np.int64(1), width - lengths[order].astype(np.int64))
    values = (order.astype(np.uint32) << 6) | lengths[order]
    filled = np.repeat(values, spans)
    table[: len(filled)] = filled
    return table, width


def _decode(bits: bytes, offsets: np.ndarray, n_ids: int, block: int, table: np.ndarray, width: int) -> np.ndarray:
    """Every block starts at its own offset, and all blocks advance together."""
    blocks = len(offsets) - 1
    out = np.zeros((block, blocks), np.uint32)
    if n_ids == 0:
        return out.reshape(-1)[:0]
    padded = np.frombuffer(bits + b"\0" * 16, np.uint8)
    windows = np.ndarray(len(padded) - 8, ">u8", padded, strides=(1,))
    at = offsets[:-1].astype(np.int64)
    sure = n_ids - block * (blocks - 1)  # ids of the last block
    down = np.uint64(64 - width)
    for step in range(block):
        if step == sure:
            at = at[:-1]
        if not len(at):
            break
        window = windows[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        found = table[(window >> down).astype(np.int64)]
        out[step, : len(at)] = found >> 6
        at = at + (found & 63)
    return out.T.reshape(-1)[:n_ids]
