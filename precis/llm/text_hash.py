"""Hashed tokens and character n-grams of a text, as numpy arrays."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; longer texts are cut between tokens.
WINDOW = 1 << 20

# An odd base for polynomial hashes and odd multipliers for mixing.
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)

#: Byte classes: 0 white space and control, 1 letters, digits, underscore and all beyond ASCII, 2 other signs.
_CLASS = np.array([0 if b <= 32 or b == 127 else 1 if b > 127 or chr(b).isalnum() or b == 95 else 2 for b in range(256)],
                  dtype=np.uint8)

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to at least ``n``."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 14, min(WINDOW, 2 * n), n) + 1
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(size, base, dtype=np.uint64))))
                      for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _window_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    kind = _CLASS[raw]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], edge))
    ends = np.concatenate((edge, [len(raw)]))
    tokens = kind[starts] > 0
    starts, ends = starts[tokens], ends[tokens]
    up, down = _tables(len(raw))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)])))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose high bits depend on all bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def token_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per token, in order: runs of word characters and runs of
    signs, A-Z lower-cased. Null or blank text: none."""
    data = (text or "").encode().lower()
    if not data:
        return np.zeros(0, dtype=np.uint64)
    if len(data) <= WINDOW:
        return _window_hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        if end < len(data):
            # the last token of a window is finished in the next one, however long it is
            end = _last_edge(data, at, end)
        parts.append(_window_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def _last_edge(data: bytes, at: int, end: int) -> int:
    """The last place up to ``end`` where the class of bytes changes; a token without
    one in the window is taken whole, to its own end."""
    kind = _CLASS[np.frombuffer(data, dtype=np.uint8, count=end - at + 1, offset=at)]
    edges = np.flatnonzero(kind[1:] != kind[:-1])
    if len(edges):
        return at + int(edges[-1]) + 1
    while end < len(data):
        kind = _CLASS[np.frombuffer(data, dtype=np.uint8, count=min(WINDOW, len(data) - end + 1), offset=end - 1)]
        edges = np.flatnonzero(kind[1:] != kind[:-1])
        if len(edges):
            return end + int(edges[0])
        end = min(len(data), end - 1 + len(kind))
    return end


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket numbers below ``2**bits``."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def word_ngram_buckets(text: str | None, bits: int) -> np.ndarray:
    """Buckets of all token unigrams and bigrams of a text."""
    one = token_hashes(text)
    two = mixed(one[:-1] * _PAIR + one[1:])
    return buckets(np.concatenate((mixed(one), two)), bits)


def char_ngram_buckets(text: str | None, longest: int, bits: int) -> np.ndarray:
    """Buckets of all character n-grams up to ``longest``, of the lower-cased text
    between two spaces."""
    points = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    gram = points + np.uint64(1)
    parts = [mixed(gram * _PAIR)]
    for n in range(2, longest + 1):
        gram = gram[:-1] * np.uint64(_BASE) + points[n - 1:] + np.uint64(n)
        parts.append(mixed(gram * _PAIR))
    return buckets(np.concatenate(parts), bits)
