"""Bootstrap confidence intervals of mean scores, per score type.

Input: the long score table (id, score_type, precision, recall, fmeasure).
Output: (score_type, measure, low, mid, high) where low/mid/high are the
``(1-c)/2``, 0.5 and ``1-(1-c)/2`` percentiles (linear interpolation) of the
resample means; ``mid`` is the median of the resample means.

Three resampling schemes, all deterministic for a seed and independent of the
number of partitions. Draws come from md5: each digest gives four 32-bit
uniforms, keyed ``seed-rep-(slot div 4)`` (exact) and ``seed-p-id-(rep div 4)``
(Poisson), part ``mod 4``:

* ``exact``  - B resamples of size n with replacement, as in the textbook
  bootstrap, at any size. Draw ``(b, k)`` picks row ``floor(u * n)`` of the id
  order; it costs n*B draw rows.
* ``poisson`` - every pair gets a Poisson(1) weight per resample; the
  resample mean is sum(w*x)/sum(w). Each task folds its weighted rows into
  partial sums per resample and only those partial sums are shuffled. It takes
  the wide score frame (one row per pair) as it is; a long score table is
  pivoted first (one shuffle of that table).

* ``tree``   - the same resamples of size n with replacement, drawn where the rows
  lie: how many draws of a resample fall into each leaf of neighbouring rows is told by
  a tree of binomial draws from the top, and the draws inside a leaf are made in the
  leaf's own task. What is shuffled is a number a resample and leaf, and the
  leaf's sums. Keys: ``seed-t-rep-lo-hi`` (52 bits, leaves lo to hi) and
  ``seed-l-rep-leaf-(slot div 4)``, part ``mod 4``.

The method is the caller's choice and never changes with the size of the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.constants import BOOTSTRAP_CONFIDENCE, BOOTSTRAP_SAMPLES
from precis.operators.ids import global_index
from precis import session
from precis.session import measured_bytes, written

MEASURES = ("precision", "recall", "fmeasure")
_TWO_32 = 4294967296.0


def check_params(confidence: float, n_samples: int) -> None:
    if confidence < 0 or confidence > 1:
        raise ValueError(f"confidence {confidence} is not between 0 and 1")
    if n_samples <= 0:
        raise ValueError(f"{n_samples} resamples: at least one is needed")


def quantiles(confidence: float) -> list[float]:
    delta = (1 - confidence) / 2
    return [delta, 0.5, 1 - delta]


def _uniform_block(h: Column, index_name: str, block: Column, limit) -> Column:
    """array of 4 structs (index = 4*block + part, u) from one md5 hex digest
    ``h`` - pass a projected column, so the digest is computed once."""
    return F.array(*[
        F.struct((block * 4 + j).cast("long").alias(index_name),
                 (F.conv(F.substring(h, 8 * j + 1, 8), 16, 10).cast("double") / F.lit(_TWO_32)).alias("u"))
        for j in range(4)
    ])


def poisson1_cdf(eps: float = 1e-15) -> list[float]:
    """Cumulative probabilities P(X <= k) of Poisson(1), k = 0.. until 1 - eps."""
    out, acc, k = [], 0.0, 0
    while True:
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
        if acc >= 1 - eps or k > 30:
            return out
        k += 1


def poisson1_weight(u: Column) -> Column:
    """Inverse CDF of Poisson(1): the number of cumulative probabilities <= u,
    as a CASE chain (stays in generated code)."""
    cdf = poisson1_cdf()
    out = F.when(u < F.lit(cdf[0]), F.lit(0.0))
    for k, c in enumerate(cdf[1:], start=1):
        out = out.when(u < F.lit(c), F.lit(float(k)))
    return out.otherwise(F.lit(float(len(cdf))))


def _intervals(means: DataFrame, confidence: float) -> DataFrame:
    q = quantiles(confidence)
    qs = "array(" + ", ".join(repr(x) for x in q) + ")"
    agg = means.groupBy("score_type").agg(
        *[F.expr(f"percentile({m}, {qs})").alias(m) for m in MEASURES]
    )
    rows = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m)[0].alias("low"), F.col(m)[1].alias("mid"), F.col(m)[2].alias("high"))
        for m in MEASURES
    ])
    return agg.select("score_type", F.inline(rows))


def bootstrap_exact(scores: DataFrame, n_samples: int = BOOTSTRAP_SAMPLES,
                    confidence: float = BOOTSTRAP_CONFIDENCE, seed: int = 0) -> DataFrame:
    """Resample b, slot k picks the row of rank floor(u * n) in id order, with u
    from md5("seed-b-(k div 4)"), 32-bit part k mod 4."""
    check_params(confidence, n_samples)
    spark = scores.sparkSession
    # The score table is read several times below: evaluate it once.
    scores = written(scores.select("id", "score_type", *MEASURES), "scores")
    ids = scores.select("id").distinct()
    n = ids.count()
    if n == 0:
        return spark.createDataFrame([], "score_type string, measure string, low double, mid double, high double")
    indexed = global_index(ids, ["id"], "idx")
    nb = (n + 3) // 4
    slot = spark.range(0, n_samples * nb)
    blocks = slot.select(
        F.floor(F.col("id") / F.lit(nb)).cast("long").alias("b"),
        (F.col("id") % F.lit(nb)).alias("kb"),
    )
    key = F.concat_ws("-", F.lit(str(seed)), F.col("b").cast("string"), F.col("kb").cast("string"))
    hashed = blocks.select("b", "kb", F.md5(key).alias("_h"))
    draws = hashed.select("b", F.inline(_uniform_block(F.col("_h"), "k", F.col("kb"), n))).where(F.col("k") < n).select(
        "b", F.floor(F.col("u") * F.lit(n)).cast("long").alias("pick")
    )
    mult = draws.groupBy("b", "pick").count()
    per_row = written(scores.join(indexed, "id").select(F.col("idx").alias("pick"), "score_type", *MEASURES), "indexed-scores")
    if measured_bytes(per_row) <= session.BROADCAST_BYTES:
        per_row = F.broadcast(per_row)
    joined = mult.join(per_row, "pick")
    means = joined.groupBy("score_type", "b").agg(
        *[(F.sum(F.col("count") * F.col(m)) / F.lit(float(n))).alias(m) for m in MEASURES]
    )
    return _intervals(means, confidence)


#: Rows of a leaf: a task holds the scores of one.
LEAF_ROWS = 65_536


def binomial_draw(u: float, n: int, p: float) -> int:
    """The number of hits in ``n`` trials at which the summed probabilities pass ``u``, from the likeliest
    number outwards (above before below), so that the steps are as few as the spread."""
    if n == 0:
        return 0
    up = down = min(n, int((n + 1) * p))
    f = math.exp(math.lgamma(n + 1) - math.lgamma(up + 1) - math.lgamma(n - up + 1)
                 + up * math.log(p) + (n - up) * math.log(1.0 - p))
    total, above, below, odds = f, f, f, p / (1.0 - p)
    mode = up
    while u >= total and (up < n or down > 0):
        if up < n:
            above *= (n - up) / (up + 1) * odds
            up, total = up + 1, total + above
            if u < total:
                return up
        if down > 0:
            below *= down / ((n - down + 1) * odds)
            down, total = down - 1, total + below
            if u < total:
                return down
    return mode


def leaf_counts(rep: int, n: int, leaf_rows: int, seed: int) -> Iterator[tuple[int, int]]:
    """(leaf, draws that fall into it) of one resample, for the leaves that get any."""
    stack = [(0, -(-n // leaf_rows), n)]
    while stack:
        lo, hi, count = stack.pop()
        if not count:
            continue
        if hi - lo == 1:
            yield lo, count
            continue
        mid = (lo + hi) // 2
        first, whole = (mid - lo) * leaf_rows, min(n, hi * leaf_rows) - lo * leaf_rows
        u = int(hashlib.md5(f"{seed}-t-{rep}-{lo}-{hi}".encode()).hexdigest()[:13], 16) / 2.0**52
        left = binomial_draw(u, count, first / whole)
        stack += [(mid, hi, count - left), (lo, mid, left)]


def _leaf_picks(rep: int, leaf: int, count: int, size: int, seed: int) -> np.ndarray:
    """How often each row of a leaf is drawn."""
    blocks = b"".join(hashlib.md5(f"{seed}-l-{rep}-{leaf}-{k}".encode()).digest() for k in range(-(-count // 4)))
    u = np.frombuffer(blocks, dtype=">u4")[:count] / _TWO_32
    return np.bincount(np.floor(u * size).astype(np.int64), minlength=size)


def bootstrap_tree(scores: DataFrame, n_samples: int = BOOTSTRAP_SAMPLES, confidence: float = BOOTSTRAP_CONFIDENCE,
                   seed: int = 0, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Resamples of size n with replacement: draws per leaf by a binomial tree, then inside each leaf."""
    check_params(confidence, n_samples)
    spark = scores.sparkSession
    scores = written(scores.select("id", "score_type", *MEASURES), "scores")
    ids = scores.select("id").distinct()
    n = ids.count()
    if n == 0:
        return spark.createDataFrame([], "score_type string, measure string, low double, mid double, high double")
    indexed = global_index(ids, ["id"], "idx").withColumn("leaf", F.floor(F.col("idx") / leaf_rows).cast("long"))
    rows = scores.join(indexed, "id").select("leaf", (F.col("idx") % leaf_rows).alias("at"), "score_type", *MEASURES)

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rep in pdf["id"]:
                yield pd.DataFrame([(rep, leaf, count) for leaf, count in leaf_counts(int(rep), n, leaf_rows, seed)],
                                   columns=["b", "leaf", "count"])

    counts = spark.range(n_samples).mapInPandas(trees, "b long, leaf long, count long")

    def draws(scored: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=["b", "score_type", *MEASURES])
        if not len(scored) or not len(drawn):
            return out
        leaf = int(scored["leaf"].iloc[0])
        size = min(leaf_rows, n - leaf * leaf_rows)
        types = sorted(scored["score_type"].unique())
        matrix = np.zeros((size, 3 * len(types)))
        for k, kind in enumerate(types):
            mine = scored[scored["score_type"] == kind]
            matrix[mine["at"].to_numpy(), 3 * k:3 * k + 3] = mine[list(MEASURES)].to_numpy()
        sums = np.stack([_leaf_picks(int(b), leaf, int(c), size, seed) @ matrix for b, c in zip(drawn["b"], drawn["count"])])
        parts = [pd.DataFrame({"b": drawn["b"].to_numpy(), "score_type": kind,
                               **{m: sums[:, 3 * k + i] for i, m in enumerate(MEASURES)}}) for k, kind in enumerate(types)]
        return pd.concat(parts, ignore_index=True)

    partial = rows.groupBy("leaf").cogroup(counts.groupBy("leaf")).applyInPandas(
        draws, "b long, score_type string, precision double, recall double, fmeasure double")
    means = partial.groupBy("score_type", "b").agg(*[(F.sum(m) / F.lit(float(n))).alias(m) for m in MEASURES])
    return _intervals(means, confidence)


def bootstrap_poisson(scores: DataFrame, n_samples: int = BOOTSTRAP_SAMPLES,
                      confidence: float = BOOTSTRAP_CONFIDENCE, seed: int = 0, types=None) -> DataFrame:
    """Poisson bootstrap of a long score table, turned into one row per id first."""
    if types is None:  # a few names; pass them to skip this extra job
        types = [r[0] for r in scores.select("score_type").distinct().collect()]
    types = sorted(types)
    wide = scores.groupBy("id").pivot("score_type", types).agg(
        F.min(F.struct(*MEASURES)).alias("s")) if types else scores.select("id")  # one row per (id, type)
    return bootstrap_poisson_wide(wide, types, n_samples, confidence, seed)


def bootstrap_poisson_wide(wide: DataFrame, types, n_samples: int = BOOTSTRAP_SAMPLES,
                           confidence: float = BOOTSTRAP_CONFIDENCE, seed: int = 0) -> DataFrame:
    """``wide``: id and one struct of measures per score type, as ``score_columns`` gives.

    Poisson(1) weight of row ``id`` in resample b: inverse CDF of u from
    md5("seed-p-id-(b div 4)"), 32-bit part b mod 4. The weight depends on the id
    only, so each is drawn once for all types."""
    check_params(confidence, n_samples)
    types = sorted(types)
    if not types:
        return wide.sparkSession.createDataFrame([], "score_type string, measure string, low double, mid double, high double")
    wide = wide.select("id", *[F.col(f"`{t}`.{m}").alias(f"{t}_{m}") for t in types for m in MEASURES])
    cols = [f"{t}_{m}" for t in types for m in MEASURES]
    nb = (n_samples + 3) // 4
    rep = wide.select("id", *[F.col(f"`{c}`").alias(c) for c in cols],
                      F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("blk"))
    key = F.concat_ws("-", F.lit(str(seed)), F.lit("p"), F.col("id").cast("string"), F.col("blk").cast("string"))
    hashed = rep.select(*cols, "blk", F.md5(key).alias("_h"))
    drawn = hashed.select(*cols, F.inline(_uniform_block(F.col("_h"), "b", F.col("blk"), n_samples))).where(
        F.col("b") < n_samples)
    weighted = drawn.select("b", *cols, poisson1_weight(F.col("u")).alias("w"))
    aggs = []
    for t in types:
        present = F.col(f"{t}_precision").isNotNull()
        aggs.append(F.sum(F.when(present, F.col("w"))).alias(f"{t}__sw"))
        aggs += [F.sum(F.col("w") * F.col(f"{t}_{m}")).alias(f"{t}__{m}") for m in MEASURES]
    sums = weighted.groupBy("b").agg(*aggs)
    per_type = F.array(*[
        F.struct(F.lit(t).alias("score_type"), F.col(f"{t}__sw").alias("sw"),
                 *[F.col(f"{t}__{m}").alias(m) for m in MEASURES])
        for t in types
    ])
    long_sums = sums.select("b", F.inline(per_type))
    means = long_sums.where(F.col("sw") > 0).select(
        "score_type", "b", *[(F.col(m) / F.col("sw")).alias(m) for m in MEASURES]
    )
    return _intervals(means, confidence)


def aggregate_scores(scores: DataFrame, method: str = "exact", types=None, **kw) -> DataFrame:
    """Intervals by the named method: ``exact``, ``tree`` or ``poisson``."""
    if method == "exact":
        return bootstrap_exact(scores, **kw)
    if method == "tree":
        return bootstrap_tree(scores, **kw)
    if method == "poisson":
        return bootstrap_poisson(scores, types=types, **kw)
    raise ValueError(f"unknown bootstrap method {method!r}")


def aggregate_report(intervals: DataFrame) -> DataFrame:
    """Rows ``{type}-R``, ``{type}-P``, ``{type}-F`` with low, mid, high (and
    ``ord`` for the file order: types sorted, then R, P, F)."""
    letter = F.when(F.col("measure") == "recall", "R").when(F.col("measure") == "precision", "P").otherwise("F")
    order = F.when(F.col("measure") == "recall", 0).when(F.col("measure") == "precision", 1).otherwise(2)
    return intervals.select(
        F.concat(F.col("score_type"), F.lit("-"), letter).alias("score_type"),
        "low", "mid", "high",
        F.col("score_type").alias("_type"), order.alias("_ord"),
    )
