"""Corpus BLEU (Papineni et al., 2002) of hypotheses against single references.

Per pair (row-local): clipped n-gram hits and hypothesis n-gram counts for
n = 1..max_n, hypothesis and reference lengths. Corpus: one global sum
(partial sums per task, a single row reaches the driver side of the plan).
BLEU = BP * exp(mean_n ln p_n), p_n = hits_n / total_n, BP = 1 if c > r else
exp(1 - r/c); 0 when any p_n is 0 (no smoothing). Reported on a 0-100 scale.
Tokens: white-space split.

``corpus_bleu_13a`` is the score as it is commonly printed: the published 13a
tokens, any number of references per hypothesis (clipped by the largest count in any;
length of the closest reference), and exponential smoothing: the n-th order without a
hit counts half as much as the one before, of a single hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.functions.text import join_wordpieces
from precis.functions.tokens import count_ngrams, multiset_overlap, ngrams, overlap_with_any, tokens_13a, whitespace_tokens


def bleu_stats(df: DataFrame, hypothesis: str = "hypothesis", reference: str = "target", max_n: int = 4,
               join_pieces: bool = False) -> DataFrame:
    h = F.col(hypothesis)
    r = F.col(reference)
    if join_pieces:
        h, r = join_wordpieces(h), join_wordpieces(r)
    toks = df.select(whitespace_tokens(h).alias("h"), whitespace_tokens(r).alias("r"))
    cols = [F.size("h").cast("long").alias("sys_len"), F.size("r").cast("long").alias("ref_len")]
    for n in range(1, max_n + 1):
        cols.append(multiset_overlap(ngrams(F.col("h"), n), ngrams(F.col("r"), n)).alias(f"hit{n}"))
        cols.append(count_ngrams(F.col("h"), n).alias(f"tot{n}"))
    return toks.select(*cols)


def corpus_bleu(df: DataFrame, hypothesis: str = "hypothesis", reference: str = "target", max_n: int = 4,
                join_pieces: bool = False) -> DataFrame:
    stats = bleu_stats(df, hypothesis, reference, max_n, join_pieces)
    names = ["sys_len", "ref_len"] + [f"{k}{n}" for n in range(1, max_n + 1) for k in ("hit", "tot")]
    sums = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    p = {n: F.when(F.col(f"tot{n}") > 0, F.col(f"hit{n}") / F.col(f"tot{n}")).otherwise(F.lit(0.0)) for n in range(1, max_n + 1)}
    any_zero = None
    for n in range(1, max_n + 1):
        z = F.col(f"hit{n}") == 0
        any_zero = z if any_zero is None else (any_zero | z)
    log_mean = sum((F.log(F.when(F.col(f"hit{n}") > 0, p[n])) for n in range(1, max_n + 1)), F.lit(0.0)) / F.lit(float(max_n))
    c, r = F.col("sys_len"), F.col("ref_len")
    bp = F.when(c == 0, F.lit(0.0)).when(c > r, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - r / c))
    bleu = F.when(any_zero | (c == 0), F.lit(0.0)).otherwise(bp * F.exp(log_mean))
    return sums.select(
        (bleu * 100).alias("bleu"),
        *[(p[n] * 100).alias(f"p{n}") for n in range(1, max_n + 1)],
        bp.alias("bp"),
        F.when(r > 0, c / r).otherwise(F.lit(0.0)).alias("ratio"),
        "sys_len", "ref_len",
    )


def corpus_bleu_13a(df: DataFrame, hypothesis: str = "hypothesis", references=("target",), max_n: int = 4,
                    smoothing: str = "exp") -> DataFrame:
    """One row: bleu, p1.. (0-100, smoothed), bp, ratio, sys_len, ref_len. ``references`` are columns; a null one
    is no reference of its row. ``smoothing``: ``exp`` or ``none``."""
    if smoothing not in ("exp", "none"):
        raise ValueError(f"unknown smoothing {smoothing!r}")
    refs = [f"r{k}" for k in range(len(references))]
    toks = df.select(F.coalesce(tokens_13a(F.col(hypothesis)), F.array().cast("array<string>")).alias("h"),
                     *[tokens_13a(F.col(c)).alias(r) for c, r in zip(references, refs)])
    size = F.size("h").cast("long")
    lengths = F.array(*[F.when(F.col(r).isNotNull(), F.struct(F.abs(F.size(r) - size).alias("off"), F.size(r).cast("long").alias("n"))) for r in refs])
    cols = [size.alias("sys_len"), F.coalesce(F.array_min(F.array_compact(lengths))["n"], F.lit(0)).alias("ref_len")]
    for n in range(1, max_n + 1):
        grams = [F.coalesce(ngrams(F.col(r), n), F.array().cast("array<string>")) for r in refs]
        cols += [overlap_with_any(ngrams(F.col("h"), n), grams).alias(f"hit{n}"), count_ngrams(F.col("h"), n).alias(f"tot{n}")]
    names = ["sys_len", "ref_len"] + [f"{k}{n}" for n in range(1, max_n + 1) for k in ("hit", "tot")]
    sums = toks.select(*cols).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    p, missed, none = [], F.lit(0), F.lit(True)
    for n in range(1, max_n + 1):
        hit, tot = F.col(f"hit{n}"), F.col(f"tot{n}")
        missed = missed + (hit == 0).cast("int")
        none = none & (hit == 0)
        smooth = 1.0 / (F.pow(F.lit(2.0), missed) * tot) if smoothing == "exp" else F.lit(0.0)
        p.append(F.when(tot == 0, F.lit(0.0)).when(hit == 0, smooth).otherwise(hit / tot))
    c, r = F.col("sys_len"), F.col("ref_len")
    bp = F.when(c == 0, F.lit(0.0)).when(c < r, F.exp(F.lit(1.0) - r / c)).otherwise(F.lit(1.0))
    empty = none | (F.least(*p) == 0) if max_n > 1 else none
    log_mean = sum((F.log(F.when(x > 0, x)) for x in p), F.lit(0.0)) / F.lit(float(max_n))
    bleu = F.when(empty, F.lit(0.0)).otherwise(bp * F.exp(log_mean))
    return sums.select((bleu * 100).alias("bleu"), *[(x * 100).alias(f"p{n}") for n, x in enumerate(p, 1)], bp.alias("bp"),
                       F.when(r > 0, c / r).otherwise(F.lit(0.0)).alias("ratio"), "sys_len", "ref_len")
