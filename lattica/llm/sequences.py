"""Vectorised hashing of byte and word sequences; everything depends on content only."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: An odd multiplier, its inverse modulo 2^64, and another multiplier for a second hash of the same content.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SECOND = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x):
    """A 64-bit finaliser: nearby values get unrelated ones."""
    x = np.asarray(x, _U).copy()
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls for texts of usual length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(4096, 1 << max(0, n - 1).bit_length())
        have = np.full(size, base, _U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def prefix_sums(units: np.ndarray, base: int = BASE) -> np.ndarray:
    """P[i] = sum of units[j] * base^j over j < i."""
    out = np.zeros(len(units) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(units.astype(_U) * powers(len(units), base), out=out[1:])
    return out


def _inverse(base: int) -> int:
    return INVERSE if base == BASE else pow(base, -1, 1 << 64)


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of units[start:end] for every span, equal for equal content."""
    with np.errstate(over="ignore"):
        raw = (sums[ends] - sums[starts]) * powers(len(sums), _inverse(base))[starts]
        return mix(raw + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def windows_hash(sums: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """The hash of every window of ``width`` units."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        return mix((sums[width:] - sums[:n]) * powers(n, _inverse(base)))


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of a text."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(text, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes, lower: bool = False, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of every word, in order; ``lower`` folds A-Z first."""
    if not text:
        return np.zeros(0, _U)
    starts, ends = word_spans(text)
    data = np.frombuffer(text, np.uint8)
    sums = prefix_sums((LOWER[data] if lower else data).astype(_U) + _U(1), base)
    return spans_hash(sums, starts, ends, base)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, each once; where each came first; which of them every key is; how often each came.

    A row of two values is one key of 128 bits.
    """
    if keys.ndim == 1:
        return np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(keys[:, 0], kind="stable")
    s = keys[order]
    if ((s[1:, 0] == s[:-1, 0]) & (s[1:, 1] != s[:-1, 1])).any():
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        s = keys[order]
    new = np.append(True, (s[1:] != s[:-1]).any(axis=1))[: len(s)]
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], order[new], inverse, np.diff(np.append(np.flatnonzero(new), len(s)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of ``width`` values, by running minima of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def anchors(units: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor grams of a sequence: (fingerprint, position, first window, last window).

    Each window of ``length`` units names the gram of ``gram`` units in it whose
    hash is least, the leftmost of equals.  What it names depends on its content
    only, so equal windows, wherever they are, name equal grams at one offset.
    """
    sums = prefix_sums(units)
    h = windows_hash(sums, gram)
    width = length - gram + 1
    if len(h) < width:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, none
    keyed = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
    least = (sliding_min(keyed, width) & _U(0xFFFFFFFF)).astype(np.int64)
    last = np.flatnonzero(np.append(least[1:] != least[:-1], True))
    first = np.append(0, last[:-1] + 1)
    at = least[last]
    return h[at], at, first, last


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs; touching spans join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
