"""Simple-8b: unsigned integers in 64-bit words, a selector in the top four bits.

A selector says how many values its word holds and in how many bits each. Two selectors
stand for runs of zeros. A value of 59 bits or more is escaped: its word holds a place in
the block's table of such values. Values are coded in blocks of a fixed size, and no word
spans two, so that blocks are encoded side by side and decoded alone, by the offsets of
their words and escapes. Everything works on whole numpy arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed values of the coding: values in a word, and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
#: Set in a value of 60 bits that is the place of an escaped value.
ESCAPE = np.uint64(1 << 59)
BLOCK = 1024

#: The distinct widths, narrowest first: their largest values, each selector's place among them, and the least place for short values.
_WIDTHS = np.unique(BITS)
_LARGEST = (np.uint64(1) << _WIDTHS.astype(np.uint64)) - np.uint64(1)
_RANK = np.searchsorted(_WIDTHS, BITS).astype(np.uint8)
_SHORT = np.searchsorted(_LARGEST, np.arange(1 << 16).astype(np.uint64)).astype(np.uint8)


@dataclass
class Coded:
    """Words and escaped values of all blocks, and where those of each block begin (one more entry marks the end)."""

    words: np.ndarray
    escaped: np.ndarray
    word_at: np.ndarray
    escape_at: np.ndarray


def _least(x: np.ndarray) -> np.ndarray:
    if int(x.max(initial=0)) < 1 << 16:
        return _SHORT[x.astype(np.intp)]
    return np.minimum(np.searchsorted(_LARGEST, x), len(_WIDTHS) - 1).astype(np.uint8)


def encode(values: np.ndarray, size: int = BLOCK) -> Coded:
    """Blocks of ``size`` unsigned 64-bit values; each word takes as many as it can."""
    x = np.ascontiguousarray(values, np.uint64)
    n, blocks = len(x), -(-len(x) // size)
    big = x >= ESCAPE
    escape_at = np.zeros(blocks + 1, np.int64)
    small, escaped = x, x[big]
    if len(escaped):
        of = np.flatnonzero(big) // size
        escape_at[1:] = np.cumsum(np.bincount(of, minlength=blocks))
        small = x.copy()
        small[big] = ESCAPE | (np.arange(len(of)) - escape_at[of]).astype(np.uint64)
    need = np.full((blocks, size), 255, np.uint8)
    need.reshape(-1)[:n] = _least(x)
    choice, widest, span = np.full((blocks, size), 15, np.uint8), need, 1
    for s in range(14, -1, -1):
        k = int(COUNTS[s])
        if size < k:
            break
        while span < k:  # the largest need among the next values, from two windows that overlap
            step = min(k, 2 * span) - span
            widest, span = np.maximum(widest[:, : widest.shape[1] - step], widest[:, step:]), span + step
        fits = widest <= _RANK[s]
        if not fits.any():
            break  # what a word of more values holds, a word of fewer values holds too
        own = choice[:, : size - k + 1]
        np.minimum(own, np.where(fits, np.uint8(s), np.uint8(15)), out=own)
    choice = choice.reshape(-1)
    starts = np.zeros(n, bool)
    at, ends = np.arange(blocks) * size, np.minimum((np.arange(blocks) + 1) * size, n)
    while len(at):  # one word of every block in a step
        starts[at] = True
        at = at + COUNTS[choice[at]]
        inside = at < ends
        at, ends = at[inside], ends[inside]
    first = np.flatnonzero(starts)
    picked = choice[first]
    words = picked.astype(np.uint64) << np.uint64(60)
    for s in np.unique(picked):
        own, bits = np.flatnonzero(picked == s), int(BITS[s])
        at, body = first[own], words[own]
        for j in range(int(COUNTS[s]) if bits else 0):
            body |= small[at + j] << np.uint64(bits * j)
        words[own] = body
    word_at = np.zeros(blocks + 1, np.int64)
    word_at[1:] = np.cumsum(np.bincount(first // size, minlength=blocks))
    return Coded(words, escaped, word_at, escape_at)


def decode(coded: Coded) -> np.ndarray:
    """The values of all blocks, the words of one selector at a time."""
    words = coded.words
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        bits, own = int(BITS[s]), np.flatnonzero(selector == s)
        at, body = first[own], words[own]
        for j in range(int(COUNTS[s]) if bits else 0):
            out[at + j] = (body >> np.uint64(bits * j)) & np.uint64((1 << bits) - 1)
        if s == 15 and len(coded.escaped):
            far = np.flatnonzero(out[at] >= ESCAPE)
            block = np.searchsorted(coded.word_at, own[far], side="right") - 1
            out[at[far]] = coded.escaped[(out[at[far]] ^ ESCAPE).astype(np.int64) + coded.escape_at[block]]
    return out
