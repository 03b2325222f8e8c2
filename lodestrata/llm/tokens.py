"""Vectorised word hashes of whole texts: a batch of UTF-8 rows becomes one array of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodestrata.llm.common import buffers

#: Bytes hashed in one step; a step ends at white space.
STEP = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}

#: A-Z become a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space: space, and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: ASCII white space, control characters and punctuation.
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[:128] = [not chr(x).isalnum() for x in range(128)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to ``n`` at least."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, STEP + 65536)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(n, np.uint64(base & _MASK))
            out[0] = 1
            _powers[name] = np.cumprod(out)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their differences over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hashed(raw: np.ndarray, first: np.ndarray, breaks: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and starts of the words of ``raw`` and the sums of their bytes' weights; ``first`` marks bytes that begin a row."""
    gap = breaks[raw]
    word = ~gap
    begins = word.copy()
    begins[1:] &= gap[:-1] | first[1:]
    ends = word.copy()
    ends[:-1] &= gap[1:] | first[1:]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _power(len(raw) + 1)
    sums = np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)])
    before = np.where(s > 0, sums[s - 1], np.uint64(0)) if len(s) else sums[:0]
    hashes = mixed((sums[e] - before) * down[s] + (e - s).astype(np.uint64))
    if weights is None:
        return hashes, s, np.zeros(0)
    sums = np.concatenate(([0.0], np.cumsum(weights[raw])))
    return hashes, s, sums[e + 1] - sums[s]


def word_hashes(texts: pa.Array, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, ASCII letters in lower case, and the row of each word.

    Null rows have none. Memory is bounded by STEP and the words, not by the longest text.
    """
    return weighed_words(texts, None, breaks)[:2]


def weighed_words(texts: pa.Array, weights: np.ndarray | None, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``word_hashes`` returns, and for each word the sum of its bytes' ``weights`` (256 numbers; none: an empty array)."""
    raw, offsets = buffers(texts)
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    hashes, places, sums, at = [], [], [np.zeros(0)], 0
    while at < len(raw):
        to = min(len(raw), at + STEP)
        if to < len(raw):
            gaps = np.flatnonzero(breaks[raw[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                while to < len(raw) and not breaks[raw[to]]:
                    to += 1
        first = np.zeros(to - at, dtype=bool)
        first[starts[np.searchsorted(starts, at) : np.searchsorted(starts, to)] - at] = True
        h, s, own = _hashed(raw[at:to], first, breaks, weights)
        hashes.append(h)
        sums.append(own)
        places.append(s + at)
        at = to
    h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    place = np.concatenate([*places, np.zeros(0, np.int64)])
    return h, np.searchsorted(offsets, place, side="right") - 1, np.concatenate(sums)


def grams(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences within rows and the word at which each begins."""
    if len(h) < n:
        return h[:0], np.zeros(0, np.int64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    return out[at], at


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes of single words."""
    h, rows = word_hashes(pa.array(words))
    assert len(rows) == len(words), "each must be one word"
    return h
