"""Word shingles of whole texts as 64-bit hashes, computed on the byte buffers of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import utf8

#: Texts are hashed this many bytes at a time; a longer text is cut between words.
PIECE = 1 << 20
_rng = np.random.default_rng(20_240_601)
_P = np.uint64(int(_rng.integers(1 << 62)) * 2 + 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = _rng.integers(1, 1 << 63, 256).astype(np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
_A, _B, _C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        m = max(n + 1, PIECE + 1)
        for key, base in (("up", _P), ("down", _P_INVERSE)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a buffer, and how many words end before each offset."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    black = ~_IS_BLANK[data]
    first, last = black.copy(), black.copy()
    cut = at[(at > 0) & (at < n)]
    keep = np.ones(n, bool)
    keep[cut] = False
    first[1:] &= ~(black[:-1] & keep[1:])
    keep = np.ones(n, bool)
    keep[cut - 1] = False
    last[:-1] &= ~(black[1:] & keep[:-1])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _C), np.searchsorted(start, at)


def _long_words(data: np.ndarray) -> np.ndarray:
    """Words of one text, a piece at a time."""
    out, n, at = [], len(data), 0
    while at < n:
        end = min(n, at + PIECE)
        while end < n and not _IS_BLANK[data[end]]:
            blank = np.flatnonzero(_IS_BLANK[data[end : end + 4096]])
            end = min(n, end + (int(blank[0]) if len(blank) else 4096))
        out.append(_words(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: index of the first, hashes of their words, and where each text's words begin and end."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        if j == i + 1 and at[j] - at[i] > PIECE:
            words = _long_words(data[at[i] : at[j]])
            yield i, words, np.array([0, len(words)])
        else:
            words, ends = _words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            yield i, words, ends
        i = j


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of size words. A text of fewer words has one for them all, one without words none."""
    for _, words, ends in word_hashes(column):
        every = words[: max(0, len(words) - size + 1)].copy()
        for k in range(1, size):
            every = every * _C + words[k : k + len(every)]
        every = mix(every)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= size:
                s = np.sort(every[a : b - size + 1])
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield s[new]
            elif b > a:
                x = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    x = mix(x * _C + w)
                yield x
            else:
                yield words[:0]
