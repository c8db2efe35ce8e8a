"""Ids in 64-bit words: the four high bits of a word select how many ids it holds and of how many bits each.

Ids are coded in blocks, each beginning with a word of its own, so that blocks are coded side by side and any
run of blocks is decoded without those before it.  A block's last word is filled up with zeros; the number of
ids in a block is not stored in words.
"""

from __future__ import annotations

import numpy as np

#: Selector, ids in a word, bits of each.  The first is the escape: an id too wide for any other stands alone.
SELECTORS = (
    (0, 1, 60),
    (1, 2, 30),
    (2, 3, 20),
    (3, 4, 15),
    (4, 5, 12),
    (5, 6, 10),
    (6, 7, 8),
    (7, 8, 7),
    (8, 10, 6),
    (9, 12, 5),
    (10, 15, 4),
    (11, 20, 3),
    (12, 30, 2),
    (13, 60, 1),
)
MOST = 60
COUNTS = np.zeros(16, np.int64)
for _s, _n, _ in SELECTORS:
    COUNTS[_s] = _n
BLOCK = 4096


def _bits(ids: np.ndarray) -> np.ndarray:
    """How many bits each id has."""
    exponent = ids.astype(np.float64).view(np.int64) >> 52  # exact, since ids have 53 bits at most
    return np.maximum(exponent - 1022, 0).astype(np.uint8)


def _widest(bits: np.ndarray) -> dict[int, np.ndarray]:
    """For each count of a selector the widest of so many ids from each place on."""
    out = {1: bits}
    for _, n, _ in SELECTORS[1:]:
        a = max(c for c in out if c < n)
        shift = n - a  # two windows of ``a`` cover one of ``n``, since n <= 2 a
        w = out[a].copy()
        np.maximum(w[:, :-shift], out[a][:, shift:], out=w[:, :-shift])
        out[n] = w
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``ids`` (unsigned, 32 bits at most), and the first word of each block."""
    n = len(ids)
    rows = -(-n // block)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = np.zeros((rows, block), np.uint64)
    wide.ravel()[:n] = ids
    own = np.zeros((rows, block + MOST), np.uint64)
    own[:, :block] = wide
    widest, chosen = _widest(_bits(own)), np.zeros(own.shape, np.uint8)
    for s, count, width in SELECTORS[1:]:
        chosen[widest[count] <= width] = s
    # a word begins where the one before it ends: all blocks take a step at once
    row = block + MOST
    base = np.arange(rows, dtype=np.int64) * row
    begins, at = np.zeros(rows * row, bool), base.copy()
    end = base + np.minimum(block, n - np.arange(rows) * block)
    flat_chosen = chosen.ravel()
    while len(at):
        begins[at] = True
        at = at + COUNTS[flat_chosen[at]]
        on = at < end
        at, end = at[on], end[on]
    starts, flat = np.flatnonzero(begins), own.ravel()
    select = flat_chosen[starts]
    words = select.astype(np.uint64) << np.uint64(60)
    for s, count, width in SELECTORS:
        own_words = np.flatnonzero(select == s)
        held, first = np.zeros(len(own_words), np.uint64), starts[own_words]
        for j in range(count):
            held |= flat[first + j] << np.uint64(j * width)
        words[own_words] |= held
    return words, np.searchsorted(starts, base)


def decode(words: np.ndarray, first: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of some consecutive whole blocks; ``first`` is the first word of each."""
    if not len(first):
        return np.zeros(0, np.uint32)
    row = block + MOST
    out = np.zeros(len(first) * row, np.uint32)
    select = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[select]
    before = np.cumsum(counts) - counts
    per_block = np.diff(np.append(first, len(words)))
    at = before - np.repeat(before[first], per_block) + np.repeat(np.arange(len(first)) * row, per_block)
    for s, count, width in SELECTORS:
        own = np.flatnonzero(select == s)
        if len(own):
            w, to, mask = words[own], at[own], np.uint64((1 << width) - 1)
            for j in range(count):
                out[to + j] = (w >> np.uint64(j * width)) & mask
    return out.reshape(len(first), row)[:, :block].ravel()[:n]
