"""Vectorised word shingles of whole texts, as sets of 64-bit hashes.

Words are runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z.  A set holds the
distinct shingles of ``width`` consecutive words; a text with fewer words has its whole word
sequence as its one shingle, and a text without words has the empty set.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes hashed at once; longer texts are one batch of their own.
BATCH_BYTES = 1_000_000

_KIND = np.ones(256, bool)  # True: part of a word
_KIND[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = (_LOWER.astype(np.uint64) + np.uint64(1)) * _Q

_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        p = np.full(n, _P, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def word_hashes(data: bytes, kind: np.ndarray = _KIND, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start offset of each word of ``data``; ``kind`` tells which bytes belong to words.

    With ``prefixes``, hashes of the longer words' first bytes, of each of these lengths, follow with the same offsets.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = kind[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts_inside = bool(len(raw)) and bool(inside[0])
    edge = np.concatenate(([0] if starts_inside else [], edge, [len(raw)] if len(raw) and inside[-1] else [])).astype(np.int64)
    first, end = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first
    length = end - first
    powers = _power(int(length.max()) + 1)
    # byte i of a word weighs P**i: summed with wrap-around, word by word
    place = np.arange(int(length.sum()), dtype=np.int64)
    begin = np.cumsum(length) - length
    inner = place - np.repeat(begin, length)
    letters = _BYTE[raw[inside]]
    letters *= powers[inner]
    h = [mix(np.add.reduceat(letters, begin) + length.astype(np.uint64) * _P)]
    at = [first]
    for n in sorted(prefixes, reverse=True):  # letters beyond the longest prefix go first
        letters[inner >= n] = 0
        long = length > n
        h.append(mix(np.add.reduceat(letters, begin)[long] + np.uint64(n << 32) * _P))
        at.append(first[long])
    return (np.concatenate(h), np.concatenate(at)) if prefixes else (h[0], first)


def _sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    data = b" ".join(texts)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    words, at = word_hashes(data)
    cuts = np.searchsorted(at, starts)
    cuts = np.append(cuts, len(words))
    n = len(words)
    if n >= width:
        joined = words[: n - width + 1].copy()
        for k in range(1, width):
            joined *= _P
            joined += words[k : n - width + 1 + k]
        joined = mix(joined)
    else:
        joined = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _P + w
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a null text has none."""
    out: list[np.ndarray] = []
    batch: list[bytes] = []
    held = 0
    for t in texts:
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if batch and held + len(b) > BATCH_BYTES:
            out += _sets_of(batch, width)
            batch, held = [], 0
        batch.append(b)
        held += len(b)
    if batch:
        out += _sets_of(batch, width)
    return out
