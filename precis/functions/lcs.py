"""Per-row longest-common-subsequence helpers (run inside pandas UDFs).

A row of the LCS table is one big integer: bit ``j`` is cleared where the length
grows at column ``j`` (bit-parallel LCS, Allison-Dix / Crochemore et al.), so a
token of ``a`` costs one addition over the bits of ``b``.

* ``lcs_length``: O(|a| * |b| / 64) word operations and O(|b|) memory.
* ``lcs_indices``: one LCS as indices into ``a`` with a fixed tie-break
  (diagonal on a match; otherwise left only when strictly larger, else up).
  Rows at square-root distances are kept and the rows between them are computed
  again on the way back, so about 2 * sqrt(|a|) rows of |b| bits are held.
* ``lsum_hits``: summary-level LCS hits (union of per-sentence LCS indices,
  clipped by token counts).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from math import isqrt

#: Sizes in bits up to which all masks, or all rows of a table, are held at once.
SMALL_SIDE, SMALL_TABLE = 1 << 12, 1 << 23


def _matches(b) -> Callable[[object], int]:
    """For a token, the bits of the places in ``b`` that hold it. Of a long ``b`` only the
    masks of its most frequent tokens are kept, sqrt(|b|) at most; others are made when asked for."""
    places: dict = {}
    for j, token in enumerate(b):
        places.setdefault(token, []).append(j)
    width = len(b) // 8 + 1
    often = 0 if len(b) <= SMALL_SIDE else isqrt(len(b))
    kept: dict = {}

    def mask(token) -> int:
        if token in kept:
            return kept[token]
        at = places.get(token)
        if at is None:
            return 0
        bits = bytearray(width)
        for j in at:
            bits[j >> 3] |= 1 << (j & 7)
        out = int.from_bytes(bits, "little")
        if len(at) > often:
            kept[token] = out
        return out

    return mask


def lcs_length(a, b) -> int:
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    mask = _matches(b)
    full = (1 << len(b)) - 1
    v = full
    for token in a:
        u = v & mask(token)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def lcs_indices(a, b) -> list[int]:
    """Indices into ``a`` of one LCS of ``a`` and ``b``, ascending."""
    m, j = len(a), len(b) - 1
    if not m or j < 0:
        return []
    mask = _matches(b)
    step = m if m * len(b) <= SMALL_TABLE else isqrt(m) + 1
    starts = range(0, m, step)
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for lo in starts[:-1]:
        for token in a[lo:lo + step]:
            u = v & mask(token)
            v = ((v + u) | (v - u)) & full
        rows.append(v)
    out = []
    for lo in reversed(starts):
        if j < 0:
            break
        # columns beyond j are not visited any more, and carries run upwards only
        inside = (1 << (j + 1)) - 1
        v = rows.pop() & inside
        left = []
        for token in a[lo:lo + step]:
            u = v & mask(token)
            total = v + u
            # a carry into a column tells that the cell to the left is one more than its upper
            # neighbour; where the length does not grow in the row above, it beats the cell above
            left.append((total ^ v ^ u) & v)
            v = (total | (v - u)) & inside
        i = len(left) - 1
        while i >= 0 and j >= 0:
            if a[lo + i] == b[j]:
                out.append(lo + i)
                i, j = i - 1, j - 1
            elif left[i] >> j & 1:
                j -= 1
            else:
                i -= 1
    return out[::-1]


def lsum_hits(ref_sents, can_sents) -> int:
    """Clipped union-LCS hits between target sentences and candidate sentences."""
    if ref_sents is None or can_sents is None or len(ref_sents) == 0 or len(can_sents) == 0:
        return 0
    cnt_r = Counter(t for s in ref_sents for t in s)
    cnt_c = Counter(t for s in can_sents for t in s)
    if not cnt_r or not cnt_c:
        return 0
    used = Counter()
    for r in ref_sents:
        union = set()
        for c in can_sents:
            union.update(lcs_indices(r, c))
        for i in union:
            used[r[i]] += 1
    return int(sum(min(k, cnt_r[t], cnt_c[t]) for t, k in used.items()))
