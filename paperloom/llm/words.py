"""Words of UTF-8 buffers, found and hashed with array arithmetic."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SEGMENT = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: bytes of words of letters and digits after lower-casing; every byte of a non-ASCII character is one
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

#: bytes of words between ASCII white space
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x09:0x0E] = NOT_SPACE[0x20] = False

CODES = np.random.Generator(np.random.PCG64(20_241)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = _powers(max(n, 4096))
    return _POWERS[0]


def spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _hash_segment(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    chars = data[within + np.repeat(starts, lengths)]
    terms = CODES[chars] * powers(int(lengths.max()))[within]
    return mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


def hashed_words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes) of the words of one buffer; equal words have equal hashes."""
    starts, ends = spans(data, is_word)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    cuts = np.searchsorted(starts, np.arange(SEGMENT, int(starts[-1]) + 1, SEGMENT))
    cuts = np.unique(np.concatenate([[0], cuts, [len(starts)]]))
    parts = [_hash_segment(data, starts[a:b], ends[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return starts, ends, np.concatenate(parts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line break after every text, and where each text starts (one entry more than texts)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return data, bounds
