"""Simple-8b word-aligned coding of ids, in blocks that are coded and decoded as arrays.

A 64-bit word has a 4-bit selector and up to 60 bits of values, all of one width. A value of
``ESCAPE`` or more is coded as ``ESCAPE`` and kept in the block's list of escapes, so one large id does
not widen its neighbours. Each word takes as many of the following values as fit.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# Fixed table of the coding: values per word and bits per value, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = (1 << 20) - 1
BLOCK = 4096
_PAD = int(COUNTS[0])
_LAST = 13  # with escapes no value is wider than 20 bits, so selectors 14 and 15 are not written


@cache
def _rounded() -> np.ndarray:
    """By value up to ``ESCAPE``: the least listed width that holds it."""
    out = np.zeros(ESCAPE + 1, np.uint8)
    low = 1
    for width in sorted({int(w) for w in WIDTHS if 0 < w <= 20}):
        out[low:] = width
        low = 1 << width
    return out


def _choices(rows: np.ndarray) -> np.ndarray:
    """The selector a word would have at every place of the padded rows.

    What fits one selector fits the next (fewer and wider values), so a place's selector is the last
    one less the number of earlier ones that fit.
    """
    choice = np.full(rows.shape, _LAST, np.uint8)
    window, size = _rounded()[rows], 1
    for selector in range(_LAST, -1, -1):
        count = int(COUNTS[selector])
        while size < count:
            step = min(size, count - size)
            window = np.concatenate((np.maximum(window[:, :-step], window[:, step:]), window[:, -step:]), axis=1)
            size += step
        if selector < _LAST:
            choice -= window <= WIDTHS[selector]
    return choice


def encode(ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(words, escapes) of each block of ``BLOCK`` ids; the last block may be shorter."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return [], []
    values = np.zeros((n_blocks, BLOCK + _PAD), np.uint64)
    full = np.zeros(n_blocks * BLOCK, np.uint64)
    full[:len(ids)] = ids
    large = full >= ESCAPE
    escapes = [full[i * BLOCK:(i + 1) * BLOCK][large[i * BLOCK:(i + 1) * BLOCK]] for i in range(n_blocks)] if large.any() else [full[:0]] * n_blocks
    values[:, :BLOCK] = np.where(large, np.uint64(ESCAPE), full).reshape(n_blocks, BLOCK)
    lengths = np.full(n_blocks, BLOCK)
    lengths[-1] = len(ids) - (n_blocks - 1) * BLOCK
    choice, flat = _choices(values.astype(np.int32)).ravel(), values.ravel()
    at = np.arange(n_blocks) * (BLOCK + _PAD)
    until, starts = at + lengths, []
    while len(at):  # all blocks take one word at a time
        starts.append(at)
        at = at + COUNTS[choice[at]]
        going = at < until
        if not going.all():
            at, until = at[going], until[going]
    start = np.sort(np.concatenate(starts))
    owner, selector = start // (BLOCK + _PAD), choice[start]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(2, _LAST + 1):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            base = start[rows]
            packed = words[rows]
            for j in range(int(COUNTS[s])):
                packed |= flat[base + j] << np.uint64(j * int(WIDTHS[s]))
            words[rows] = packed
    return np.split(words, np.searchsorted(owner, np.arange(1, n_blocks))), escapes


def decode(words: np.ndarray, words_per_block: np.ndarray, total: int, escapes: np.ndarray) -> np.ndarray:
    """The ``total`` ids of consecutive blocks; all blocks but the last hold ``BLOCK``."""
    n_blocks = len(words_per_block)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(n_blocks), words_per_block)
    first = np.cumsum(words_per_block) - words_per_block
    start = owner * (BLOCK + _PAD) + before - before[first][owner] if n_blocks else before
    out = np.zeros(n_blocks * (BLOCK + _PAD), np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            base, word = start[rows], words[rows]
            width = int(WIDTHS[s])
            mask = np.uint64((1 << width) - 1)
            for j in range(int(COUNTS[s])):
                out[base + j] = (word >> np.uint64(j * width)) & mask
    ids = out.reshape(n_blocks, BLOCK + _PAD)[:, :BLOCK].ravel()[:total]
    if len(escapes):
        ids[ids == ESCAPE] = escapes
    return ids
