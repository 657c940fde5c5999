"""Token-level Column expressions: splitting, filters, n-grams, overlaps.

Tokens are ``array<string>`` columns; all work is done with Spark's
higher-order functions so it runs row-locally in the JVM with no shuffle.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

from precis.constants import PY_SPACE_CLASS, PUNCTUATION, PY_SPACE_CHARS
from precis.functions.text import _col

# Stop-word lists are Spark ML's defaults (StopWordsRemover); they are read
# from the Spark ML jar so that the same list can be embedded in a literal
# expression and in oracle SQL without starting a JVM.
LANG_LISTS = {
    "en": "english",
    "ru": "russian",
    "fr": "french",
    "de": "german",
    "es": "spanish",
}


@functools.lru_cache(maxsize=None)
def stopwords(language: str = "english") -> tuple[str, ...]:
    language = LANG_LISTS.get(language, language)
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if not jars:  # fall back to the JVM when the jar is not next to pyspark
        from pyspark.ml.feature import StopWordsRemover

        return tuple(StopWordsRemover.loadDefaultStopWords(language))
    with zipfile.ZipFile(jars[0]) as z:
        raw = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8")
    return tuple(w for w in raw.split("\n") if w)


def split_space(c) -> Column:
    """``str.split(" ")``: keeps empty tokens."""
    return F.split(_col(c), " ", -1)


def drop_stopwords(tokens, words) -> Column:
    """Remove tokens found in ``words`` (order and duplicates of the rest kept).

    ``words`` is a list (one language) or a Column holding the per-row list.
    A literal list is turned into a hash lookup (InSet) by the optimizer.
    """
    if isinstance(words, Column):
        return F.filter(_col(tokens), lambda x: ~F.array_contains(words, x))
    words = list(words)
    return F.filter(_col(tokens), lambda x: ~x.isin(words))


def drop_stopwords_by_lang(tokens, lang_col, languages=("en", "fr", "de", "es", "ru")) -> Column:
    """Per-row stop-word list chosen by a language code column."""
    tokens = _col(tokens)
    lang_col = _col(lang_col)
    out = None
    for code in languages:
        branch = drop_stopwords(tokens, stopwords(code))
        out = F.when(lang_col == code, branch) if out is None else out.when(lang_col == code, branch)
    return out.otherwise(tokens)


def drop_punct_tokens(tokens) -> Column:
    """Drop ``" "`` and tokens whose stripped form is a substring of the
    ASCII punctuation string (so ``""``, ``"."``, ``"()"`` go, ``".."`` stays)."""
    return F.filter(
        _col(tokens),
        lambda x: (x != F.lit(" ")) & ~F.lit(PUNCTUATION).contains(F.btrim(x, F.lit(PY_SPACE_CHARS))),
    )


def rouge_tokens(c, ascii_only: bool = True) -> Column:
    """Scoring tokenizer: lower, non ``[a-z0-9]`` runs to space, split, drop
    empties (so Cyrillic text has no tokens). ``ascii_only=False`` keeps
    letters and digits of every script instead (an option, not the default)."""
    pattern = "[^a-z0-9]+" if ascii_only else r"[^\p{L}\p{N}]+"
    spaced = F.regexp_replace(F.lower(_col(c)), pattern, " ")
    return F.array_remove(F.split(spaced, " ", -1), "")


def whitespace_tokens(c) -> Column:
    """Split on runs of white space, no empty tokens."""
    return F.array_remove(F.split(_col(c), r"[ \t\n\x0b\x0c\r]+", -1), "")


def ngrams(tokens, n: int) -> Column:
    """All n-grams (space-joined), in order; empty when fewer than n tokens."""
    t = _col(tokens)
    if n == 1:  # the 1-grams are the tokens themselves
        return t
    k = F.size(t) - F.lit(n - 1)
    return F.when(
        k > 0,
        F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(t, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


# The published 13a tokenisation (references to signs, then places where a blank is put).
ENTITIES_13A = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
RULES_13A = (
    (r"([{-~\[-` -&(-+:-@/])", r" $1 "),
    (r"([^0-9])([.,])", r"$1 $2 "),
    (r"([.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)


def tokens_13a(c) -> Column:
    """Tokens as BLEU scores are commonly reported: signs by themselves, points and commas unless inside
    numbers, a hyphen after a digit; case is kept. Null: null."""
    line = _col(c)
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES_13A):
        line = F.replace(line, F.lit(old), F.lit(new))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pattern, new in RULES_13A:
        line = F.regexp_replace(line, pattern, new)
    return F.array_remove(F.split(line, PY_SPACE_CLASS + "+", -1), "")


def overlap_with_any(a, others: list) -> Column:
    """``sum over distinct x of min(count_a(x), the largest count(x) in any of others)``, row-local: the elements
    are tagged by side, sorted, and the runs of equal values walked."""
    sides = [a, *others]

    def marked(side, k: int) -> Column:
        return F.transform(_col(side), lambda x: F.struct(x.alias("v"), F.lit(k).alias("s")))

    tagged = F.array_sort(F.concat(*[marked(side, k) for k, side in enumerate(sides)]))
    zero = F.struct(F.lit(None).cast("string").alias("v"), F.array(*[F.lit(0).cast("long") for _ in sides]).alias("n"),
                    F.lit(0).cast("long").alias("hit"))

    def closed(acc):
        return acc["hit"] + F.least(acc["n"][0], F.array_max(F.slice(acc["n"], 2, len(others))))

    def step(acc, e):
        same = F.coalesce(acc["v"] == e["v"], F.lit(False))
        one = F.array(*[(e["s"] == k).cast("long") for k in range(len(sides))])
        n = F.when(same, F.zip_with(acc["n"], one, lambda x, y: x + y)).otherwise(one)
        return F.struct(e["v"].alias("v"), n.alias("n"), F.when(same, acc["hit"]).otherwise(closed(acc)).alias("hit"))

    return F.aggregate(tagged, zero, step, closed)


def multiset_overlap(a, b) -> Column:
    """``sum over distinct x of min(count_a(x), count_b(x))`` for two arrays.

    Row-local and O((m+n) log(m+n)): tag the elements by side, sort, and walk
    the runs of equal values with ``aggregate``. No explode, no shuffle.
    """
    tagged = F.array_sort(
        F.concat(
            F.transform(_col(a), lambda x: F.struct(x.alias("v"), F.lit(0).alias("s"))),
            F.transform(_col(b), lambda x: F.struct(x.alias("v"), F.lit(1).alias("s"))),
        )
    )
    zero = F.struct(
        F.lit(None).cast("string").alias("v"),
        F.lit(0).cast("long").alias("ca"),
        F.lit(0).cast("long").alias("cb"),
        F.lit(0).cast("long").alias("hit"),
    )

    def step(acc, e):
        same = acc["v"] == e["v"]
        ia = (F.lit(1) - e["s"]).cast("long")
        ib = e["s"].cast("long")
        return F.when(
            same.isNotNull() & same,
            F.struct(e["v"].alias("v"), (acc["ca"] + ia).alias("ca"), (acc["cb"] + ib).alias("cb"), acc["hit"].alias("hit")),
        ).otherwise(
            F.struct(
                e["v"].alias("v"),
                ia.alias("ca"),
                ib.alias("cb"),
                (acc["hit"] + F.least(acc["ca"], acc["cb"])).alias("hit"),
            )
        )

    return F.aggregate(tagged, zero, step, lambda acc: acc["hit"] + F.least(acc["ca"], acc["cb"]))


def count_ngrams(tokens, n: int) -> Column:
    """Number of n-grams: ``max(len - n + 1, 0)`` as long."""
    return F.greatest(F.size(_col(tokens)) - F.lit(n - 1), F.lit(0)).cast("long")


def explode_tokens(df, array_col, alias: str = "token", pos_alias: str | None = None, keep=()):
    """Rows of ``keep`` columns + one row per element of ``array_col``.

    Uses ``explode_outer`` and drops the null rows: same rows as ``explode``
    for arrays without null elements, but the optimizer does not infer a
    ``size(arr) > 0`` filter and push it below the projection that computes
    the array - which would evaluate a costly array expression again."""
    arr = F.col(array_col) if isinstance(array_col, str) else array_col
    if pos_alias:  # an array without elements has no position; a null element has one
        return df.select(*keep, F.posexplode_outer(arr).alias(pos_alias, alias)).where(F.col(pos_alias).isNotNull())
    return df.select(*keep, F.explode_outer(arr).alias(alias)).where(F.col(alias).isNotNull())
