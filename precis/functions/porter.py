"""Porter's suffix-stripping algorithm, as published (Program 14(3), 1980) or with
the additions that have become common since (``extended``): a few irregular
words, ``ies``/``ied`` of four-letter words, ``y`` after a consonant only, the endings
``bli``, ``fulli`` and ``logi``, ``alli`` before the other endings of its step, and
two-letter vowel-consonant stems that end like short syllables.

A small per-token helper; it is applied to distinct tokens or token arrays
inside Arrow-batched pandas UDFs with a per-process cache.
"""

from __future__ import annotations

import functools


def _is_cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in "aeiou":
        return False
    if ch == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        vowel = not _is_cons(stem, i)
        if prev_vowel and not vowel:
            m += 1
        prev_vowel = vowel
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str, extended: bool) -> bool:
    if len(w) == 2:
        return extended and not _is_cons(w, 0) and _is_cons(w, 1)
    return (
        len(w) >= 3
        and _is_cons(w, len(w) - 3)
        and not _is_cons(w, len(w) - 2)
        and _is_cons(w, len(w) - 1)
        and w[-1] not in "wxy"
    )


def _apply(w: str, rules, min_m: int):
    """Longest matching suffix wins; if its condition fails nothing changes."""
    for suffix, repl, *cond in rules:
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            ok = _measure(stem) > min_m and (not cond or cond[0](stem))
            return stem + repl if ok else w
    return w


# Irregular words of the extended form.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix rules of steps 2, 3 and 4, longest first within a step.
_STEP2 = sorted(
    [
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
        ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
        ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
        ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
        ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ],
    key=lambda r: -len(r[0]),
)
_STEP2_EXTENDED = sorted(
    [("bli", "ble") if r[0] == "abli" else r for r in _STEP2] + [("fulli", "ful")], key=lambda r: -len(r[0]))
_STEP3 = sorted(
    [
        ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
        ("ical", "ic"), ("ful", ""), ("ness", ""),
    ],
    key=lambda r: -len(r[0]),
)
_STEP4 = sorted(
    [
        ("al", ""), ("ance", ""), ("ence", ""), ("er", ""), ("ic", ""),
        ("able", ""), ("ible", ""), ("ant", ""), ("ement", ""), ("ment", ""),
        ("ent", ""), ("ion", "", lambda s: s[-1:] in ("s", "t")), ("ou", ""),
        ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""),
    ],
    key=lambda r: -len(r[0]),
)


def _step1ab(w: str, extended: bool) -> str:
    if extended and w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]

    if extended and w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suf in ("ed", "ing"):
        if w.endswith(suf) and _has_vowel(w[: -len(suf)]):
            w = w[: -len(suf)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double_cons(w):
                return w if w[-1] in "lsz" else w[:-1]
            return w + "e" if _measure(w) == 1 and _cvc(w, extended) else w
    return w


def _step2(w: str, extended: bool) -> str:
    if not extended:
        return _apply(w, _STEP2, 0)
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi"):  # measured with its o
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _apply(w, _STEP2_EXTENDED, 0)


def _stem(w: str, extended: bool) -> str:
    if extended and w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _step1ab(w, extended)
    if w.endswith("y") and (len(w) > 2 and _is_cons(w, len(w) - 2) if extended else _has_vowel(w[:-1])):
        w = w[:-1] + "i"
    w = _step2(w, extended)
    w = _apply(w, _STEP3, 0)
    w = _apply(w, _STEP4, 1)
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1], extended)):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@functools.lru_cache(maxsize=200_000)
def stem(word: str, extended: bool = False) -> str:
    return _stem(word, extended)
