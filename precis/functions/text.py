"""Text scalars as Spark Column expressions.

Every function maps Column -> Column and stays inside the JVM (regexp_replace,
split, higher-order functions), except the HTML entity fallback, which hands
only rows with unusual entities to ``html.unescape`` in an Arrow-batched UDF.

The clean-up rules run with ``(?d)`` (UNIX_LINES) so that ``.`` excludes only
``\\n`` - the meaning it has in Python's ``re`` and in RE2 (the oracle SQL).
"""

from __future__ import annotations

import functools
import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.constants import (
    CLEANUP_RULES,
    END_CHARS,
    END_CHARS_STRICT,
    PY_SPACE_CLASS,
    SENTENCE_END,
    SENTENCE_START,
)

UNIX_LINES = "(?d)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_chain(c, rules) -> Column:
    """Apply (pattern, replacement) rules in order, each with UNIX_LINES."""
    out = _col(c)
    for pattern, repl in rules:
        out = F.regexp_replace(out, UNIX_LINES + pattern, repl)
    return out


def _literal(pattern: str) -> str | None:
    """The character a one-character pattern (``:`` or ``\\!``) matches."""
    if len(pattern) == 1:
        return pattern
    if len(pattern) == 2 and pattern[0] == "\\":
        return pattern[1]
    return None


def compiled_cleanup_rules(rules=tuple(CLEANUP_RULES)):
    """The clean-up rules with the same result in fewer passes.

    * a character-class rule that replaces by a space removes those
      characters, so a later rule whose pattern is one of them cannot match
      and is skipped (here ``\\.`` and ``\\,`` after the class rule);
    * consecutive rules that each put spaces around one literal character
      commute (the inserted spaces match none of them), so rules with the same
      replacement shape become one pass with a back-reference.
    The oracle SQL applies the rules one by one; both must agree."""
    return list(_compiled(tuple(rules)))


@functools.lru_cache(maxsize=None)
def _compiled(rules):
    removed: set = set()
    out = []  # (pattern, replacement, shape, chars)
    for pat, rep in rules:
        lit = _literal(pat)
        if lit is None:
            if pat.startswith("[") and pat.endswith("]") and not pat.startswith("[^") and rep == " ":
                removed |= set(pat[1:-1].replace("\\", ""))
            out.append((pat, rep, None, None))
            continue
        if lit in removed:
            continue
        if rep.replace(lit, "\0").strip() == "\0":  # spaces around the character
            shape = rep.replace(lit, "$1")
            chars = (out[-1][3] + lit) if out and out[-1][2] == shape else lit
            if out and out[-1][2] == shape:
                out.pop()
            out.append(("([" + "".join("\\" + ch for ch in chars) + "])", shape, shape, chars))
            continue
        out.append((pat, rep, None, None))
    return tuple((p, r) for p, r, _, _ in out)


def cleanup(c) -> Column:
    """Lower-case, drop URLs to end of line, punctuation rules (fixed order)."""
    return regex_chain(F.lower(_col(c)), compiled_cleanup_rules())


def _end_class(strict: bool) -> str:
    chars = END_CHARS_STRICT if strict else END_CHARS
    return "".join("\\" + ch if ch in "\\^]-[" else ch for ch in chars)


def fix_missing_period(c, strict: bool = False) -> Column:
    """Append " ." unless the line is empty or ends in an end character
    (``strict=True``: also after ``”`` and ``)``).

    One anchored replacement, so the argument is evaluated once: the last
    character, when it is not an end character, is replaced by itself + " ."."""
    not_end = _end_class(strict)
    return F.regexp_replace(_col(c), f"(?s)([^{not_end}])\\z", "$1 .")


def fix_missing_period_lines(c, strict: bool = False) -> Column:
    """``fix_missing_period`` applied to every ``\\n``-separated line of a text
    in one multi-line replacement (empty lines stay empty)."""
    not_end = _end_class(strict)
    return F.regexp_replace(_col(c), f"(?md)([^{not_end}\\n])$", "$1 .")


def cleanup_lines(c, strip: bool = False, fix_period: bool = True, strict_end: bool = False) -> Column:
    """Per-line clean-up of a ``\\n``-separated text in whole-text passes.

    Equals splitting on ``\\n`` and applying (strip,) clean-up and the period
    fix to every line, because no rule matches across a ``\\n`` once the URL
    rule drops its trailing ``[\\r\\n]*`` (inside one line it can only match
    nothing). Line count and order are unchanged."""
    out = _col(c)
    if strip:
        cls = PY_SPACE_CLASS.replace("\\n", "")
        out = F.regexp_replace(out, rf"(?md)^{cls}+|{cls}+$", "")
    rules = compiled_cleanup_rules()
    out = regex_chain(F.lower(out), [(rules[0][0].replace("[\\r\\n]*", ""), rules[0][1])] + rules[1:])
    return fix_missing_period_lines(out, strict_end) if fix_period else out


def squeeze_spaces(c) -> Column:
    """Collapse runs of U+0020 into one."""
    return F.regexp_replace(_col(c), " +", " ")


def newlines_to_space(c) -> Column:
    return F.replace(_col(c), F.lit("\n"), F.lit(" "))


def drop_newlines(c) -> Column:
    return F.replace(_col(c), F.lit("\n"), F.lit(""))


def split_sentences(c) -> Column:
    """Sentences are the non-empty ``\\n``-separated pieces."""
    return F.array_remove(F.split(_col(c), "\n", -1), "")


def wrap_sentences(arr) -> Column:
    """``<s> sent </s>`` for each element, joined by one space."""
    return F.array_join(
        F.transform(
            _col(arr),
            lambda x: F.concat(F.lit(SENTENCE_START + " "), x, F.lit(" " + SENTENCE_END)),
        ),
        " ",
    )


def join_wordpieces(c) -> Column:
    """Undo word-piece splitting: ``" ##"`` -> ``""``."""
    return F.replace(_col(c), F.lit(" ##"), F.lit(""))


# ---------------------------------------------------------------------------
# HTML -> text
# ---------------------------------------------------------------------------

# All markup in one left-to-right pass, so that what looks like a tag inside a
# comment, a script or a quoted attribute value is not one: comments, bodies that
# give no text (up to their end tag or the end of the page), declarations and
# instructions, tags with quoted attribute values.
_ATTRIBUTES = r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+"""
_BODIES = "|".join(rf"<{name}\b{_ATTRIBUTES}>.*?(?:</{name}\b[^>]*>|\z)" for name in ("script", "style", "template"))
MARKUP = rf"(?is)<!--.*?(?:-->|\z)|{_BODIES}|<[!?][^>]*>|</?[a-z]{_ATTRIBUTES}>"

# Named and numeric references decoded without Python;
# "&amp;" comes last so that a decoded "&" is never decoded again.
NATIVE_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", "\xa0"),
    ("&copy;", "\xa9"),
    ("&middot;", "\xb7"),
    ("&amp;", "&"),
]
_NATIVE_NAMES = "|".join(e[0][1:-1] for e in NATIVE_ENTITIES)
# A reference the native table does not decode exactly.
OTHER_ENTITY = rf"&(?!(?:{_NATIVE_NAMES});)[#A-Za-z]"


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else _html.unescape(v))


def strip_markup(c) -> Column:
    return F.regexp_replace(_col(c), MARKUP, "")


def decode_entities_native(c) -> Column:
    out = _col(c)
    for ent, ch in NATIVE_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def decode_entities(stripped) -> Column:
    """Entity decoding of markup-free text; ``stripped`` is read three times,
    so pass a column (see ``with_html_text``)."""
    stripped = _col(stripped)
    odd = stripped.rlike(OTHER_ENTITY)
    decoded = F.when(odd, _unescape(F.when(odd, stripped))).otherwise(
        decode_entities_native(stripped)
    )
    return F.replace(decoded, F.lit("\xa0"), F.lit(" "))


def html_to_text(c) -> Column:
    """All text nodes of a page, entities decoded, U+00A0 -> space.

    script/style/template bodies, comments, doctype and processing
    instructions give no text. Rows whose references are all in the native
    table never leave the JVM; the rest go through ``html.unescape``.
    For DataFrames prefer ``with_html_text`` (markup is stripped once).
    """
    return decode_entities(strip_markup(c))


def with_html_text(df, html_col: str, out_col: str):
    """``df`` plus ``out_col`` = text of ``html_col``, in two projections."""
    tmp = f"_{out_col}_stripped"
    return df.withColumn(tmp, strip_markup(F.col(html_col))).withColumn(
        out_col, decode_entities(F.col(tmp))
    ).drop(tmp)
