"""ROUGE-N, ROUGE-L and ROUGE-Lsum over a pair table (id, target, prediction).

Plan shape: one narrow stage. Tokens are computed once per side, n-gram hits
are a row-local multiset intersection (``multiset_overlap``), LCS lengths and
summary-level hits come from small Arrow-batched UDFs. No explode, no shuffle:
the score of a pair never depends on another pair.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.constants import DEFAULT_ROUGE_TYPES
from precis.functions.lcs import lcs_length, lsum_hits
from precis.functions.porter import stem
from precis.functions.text import split_sentences
from precis.functions.tokens import count_ngrams, multiset_overlap, ngrams, rouge_tokens

SCORE_SCHEMA = "id long, score_type string, precision double, recall double, fmeasure double"
MEASURES = ("precision", "recall", "fmeasure")


def check_rouge_types(types) -> list[str]:
    out = []
    for t in types:
        if t in ("rougeL", "rougeLsum"):
            out.append(t)
            continue
        if re.match(r"rouge[0-9]$", t):
            if int(t[5:]) <= 0:
                raise ValueError(f"{t}: n-grams have at least one token")
            out.append(t)
            continue
        raise ValueError(f"no such measure: {t!r}")
    return out


def stem_if_long(token: str) -> str:
    """Stem (extended Porter) of a token of more than three characters; others as they are."""
    return stem(token, True) if len(token) > 3 else token


def _score_stem(token: str | None) -> str | None:
    """The stem that scoring counts, else null: only ``[a-z0-9]+`` ones stay."""
    out = None if token is None else stem_if_long(token)
    return out if out and out.isascii() and out.isalnum() and out.lower() == out else None


def _stem_elements(tokens: pa.Array) -> pa.Array:
    """Scoring stems in every list; the distinct tokens of a batch are stemmed once each."""
    coded = tokens.flatten().dictionary_encode()
    stems = pa.array([_score_stem(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    stays = stems.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(stays)))[np.concatenate(([0], np.cumsum(sizes)))]
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), stems.drop_null(), mask=pc.is_null(tokens))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Porter-stem tokens longer than 3 characters, keep ``[a-z0-9]+`` ones."""
    return _stem_elements(tokens)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def stem_sentence_tokens(sents: pa.Array) -> pa.Array:
    """``stem_tokens`` for every sentence of an ``array<array<string>>``
    (a Python UDF cannot run inside a higher-order function's lambda)."""
    sizes = pc.fill_null(pc.list_value_length(sents), 0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.ListArray.from_arrays(ends, _stem_elements(sents.flatten()), mask=pc.is_null(sents))


@F.arrow_udf(T.StringType())
def stem_word(words: pa.Array) -> pa.Array:
    """``stem_if_long`` of one token per row."""
    coded = words.dictionary_encode()
    stems = [None if w is None else stem_if_long(w) for w in coded.dictionary.to_pylist()]
    return pa.array(stems, pa.string()).take(coded.indices)


@F.pandas_udf(T.LongType())
def lcs_length_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(T.LongType())
def lsum_hits_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lsum_hits(x, y) for x, y in zip(a, b)], dtype="int64")


def fmeasure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def _score(p: Column, r: Column) -> Column:
    p = p.cast("double")
    r = r.cast("double")
    return F.struct(p.alias("precision"), r.alias("recall"), fmeasure(p, r).alias("fmeasure"))


def tokenize_for_scoring(c, use_stemmer: bool = False, ascii_only: bool = True) -> Column:
    toks = rouge_tokens(c, ascii_only)
    return stem_tokens(toks) if use_stemmer else toks


# Each score is computed in two projections: the costly count (n-gram hits,
# LCS length, summary-level hits) is materialised as a column first, then
# precision / recall / F read that column (no re-evaluation per consumer).

def rouge_n_hits(t: Column, p: Column, n: int) -> Column:
    return multiset_overlap(ngrams(t, n), ngrams(p, n))


def rouge_n_score(t: Column, p: Column, n: int, hits: Column) -> Column:
    hits = hits.cast("double")
    return _score(hits / F.greatest(count_ngrams(p, n), F.lit(1)), hits / F.greatest(count_ngrams(t, n), F.lit(1)))


def rouge_l_score(t: Column, p: Column, lcs: Column) -> Column:
    lcs = lcs.cast("double")
    empty = (F.size(t) == 0) | (F.size(p) == 0)
    return F.when(empty, _score(F.lit(0.0), F.lit(0.0))).otherwise(_score(lcs / F.size(p), lcs / F.size(t)))


def _total_tokens(sents: Column) -> Column:
    return F.aggregate(sents, F.lit(0).cast("long"), lambda acc, s: acc + F.size(s))


def rouge_lsum_score(m: Column, n: Column, empty: Column, hits: Column) -> Column:
    hits = hits.cast("double")
    return F.when(empty, _score(F.lit(0.0), F.lit(0.0))).otherwise(_score(hits / n, hits / m))


def score_columns(df: DataFrame, rouge_types=DEFAULT_ROUGE_TYPES, use_stemmer: bool = False,
                  target: str = "target", prediction: str = "prediction", id_col: str = "id",
                  ascii_only: bool = True) -> DataFrame:
    """(id, one struct<precision, recall, fmeasure> column per rouge type)."""
    types = check_rouge_types(rouge_types)
    need_lsum = "rougeLsum" in types
    cols = [F.col(id_col).alias("id"),
            tokenize_for_scoring(F.col(target), use_stemmer, ascii_only).alias("_tt"),
            tokenize_for_scoring(F.col(prediction), use_stemmer, ascii_only).alias("_pt")]
    if need_lsum:
        def sentence_tokens(c):
            sents = F.transform(split_sentences(F.col(c)), lambda s: rouge_tokens(s, ascii_only))
            return stem_sentence_tokens(sents) if use_stemmer else sents
        cols += [sentence_tokens(target).alias("_ts"), sentence_tokens(prediction).alias("_ps")]
    tok = df.select(*cols)
    t, p = F.col("_tt"), F.col("_pt")
    counts = [F.col("*")]
    for ty in types:
        if ty == "rougeL":
            counts.append(lcs_length_udf(t, p).alias(f"_c_{ty}"))
        elif ty == "rougeLsum":
            ts, ps = F.col("_ts"), F.col("_ps")
            counts += [_total_tokens(ts).alias("_lsum_m"), _total_tokens(ps).alias("_lsum_n"),
                       lsum_hits_udf(ts, ps).alias(f"_c_{ty}")]
        else:
            counts.append(rouge_n_hits(t, p, int(ty[5:])).alias(f"_c_{ty}"))
    counted = tok.select(*counts)
    out = [F.col("id")]
    for ty in types:
        c = F.col(f"_c_{ty}")
        if ty == "rougeL":
            out.append(rouge_l_score(t, p, c).alias(ty))
        elif ty == "rougeLsum":
            m, n = F.col("_lsum_m"), F.col("_lsum_n")
            empty = (F.size("_ts") == 0) | (F.size("_ps") == 0) | (m == 0) | (n == 0)
            out.append(rouge_lsum_score(m, n, empty, c).alias(ty))
        else:
            out.append(rouge_n_score(t, p, int(ty[5:]), c).alias(ty))
    return counted.select(*out)


def score_pairs(df: DataFrame, rouge_types=DEFAULT_ROUGE_TYPES, use_stemmer: bool = False,
                target: str = "target", prediction: str = "prediction", id_col: str = "id",
                ascii_only: bool = True) -> DataFrame:
    """Long score table (id, score_type, precision, recall, fmeasure)."""
    types = check_rouge_types(rouge_types)
    wide = score_columns(df, types, use_stemmer, target, prediction, id_col, ascii_only)
    tagged = F.array(*[
        F.struct(F.lit(ty).alias("score_type"), F.col(f"`{ty}`.precision").alias("precision"),
                 F.col(f"`{ty}`.recall").alias("recall"), F.col(f"`{ty}`.fmeasure").alias("fmeasure"))
        for ty in types
    ])
    return wide.select("id", F.inline(tagged))


def example_report(df: DataFrame, rouge_types=DEFAULT_ROUGE_TYPES, use_stemmer: bool = False,
                   target: str = "target", prediction: str = "prediction", id_col: str = "id") -> DataFrame:
    """Per-example wide rows: id, ``{type}-P``, ``{type}-R``, ``{type}-F`` for sorted types."""
    types = sorted(check_rouge_types(rouge_types))
    wide = score_columns(df, types, use_stemmer, target, prediction, id_col)
    cols = [F.col("id")]
    for ty in types:
        cols += [F.col(f"`{ty}`.precision").alias(f"{ty}-P"),
                 F.col(f"`{ty}`.recall").alias(f"{ty}-R"),
                 F.col(f"`{ty}`.fmeasure").alias(f"{ty}-F")]
    return wide.select(*cols)


def ngram_table(df: DataFrame, n_values=(1, 2, 3), target: str = "target", prediction: str = "prediction",
                id_col: str = "id") -> DataFrame:
    """Long n-gram count table (id, n, ngram, tc, pc): per pair and n, how often
    each n-gram occurs in the target and in the prediction."""
    toks = df.select(F.col(id_col).alias("id"), rouge_tokens(F.col(target)).alias("t"),
                     rouge_tokens(F.col(prediction)).alias("p"))

    def tagged(side: str, n: int, prediction: int):
        return F.transform(ngrams(F.col(side), n), lambda g: F.struct(
            F.lit(n).alias("n"), g.alias("ngram"), F.lit(prediction).alias("s")))

    # counted inside the row: sort, then measure the runs of equal (n, ngram)
    grams = toks.select("id", F.sort_array(F.concat(*[
        tagged(side, n, k) for n in n_values for k, side in enumerate(("t", "p"))])).alias("g"))
    g = F.col("g")
    # (outer explode and null rows dropped after it: no condition on the arrays is pushed below them)
    places = F.when(F.size(g) > 0, F.sequence(F.lit(1), F.size(g)))
    starts = F.filter(places, lambda i: (i == 1) | (
        F.struct(F.get(g, i - 1)["n"], F.get(g, i - 1)["ngram"]) != F.struct(F.get(g, i - 2)["n"], F.get(g, i - 2)["ngram"])))
    runs = grams.select("id", "g", starts.alias("at"))
    size = F.size("g")

    def counted(i, k):
        end = F.coalesce(F.get(F.col("at"), k + 1), size + 1)
        both = end - i
        ours = F.size(F.filter(F.slice(g, i, both), lambda x: x["s"] == 0))
        return F.struct(F.get(g, i - 1)["n"].alias("n"), F.get(g, i - 1)["ngram"].alias("ngram"),
                        ours.cast("long").alias("tc"), (both - ours).cast("long").alias("pc"))

    return runs.select("id", F.transform("at", counted).alias("c")).select("id", F.inline_outer("c")).where("n is not null")
