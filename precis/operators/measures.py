"""Scores of any shape, and bootstrap state to which scores can be added over time.

A scorer may give any number of named measures per score type: a named tuple or a
mapping names them, a plain sequence numbers them, a single number is ``value``. A
pair's scores travel as one row, an array of (score_type, measure, value).

State: for each type, measure and resample the sum of the weights and the weighted
sum. The Poisson(1) weight of a pair in a resample hangs on its id and the seed
alone (as in ``bootstrap_poisson``), so states of any shards add up to the state of
all pairs: new shards are added without reading old scores. Resample -1 is the
sample itself. A task folds its pairs before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from numbers import Real

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.constants import BOOTSTRAP_CONFIDENCE, BOOTSTRAP_SAMPLES
from precis.operators.bootstrap import _uniform_block, check_params, poisson1_weight, quantiles
from precis.operators.rouge import MEASURES

PACKED = "id long, scores array<struct<score_type:string,measure:string,value:double>>"
_STATE = ["score_type", "measure", "resample"]


def named_values(score) -> list[tuple[str, float]]:
    """(measure, value) of one score, whatever its shape."""
    if isinstance(score, Mapping):
        return [(str(name), float(value)) for name, value in score.items()]
    if isinstance(score, Real):
        return [("value", float(score))]
    names = getattr(score, "_fields", None) or [str(i) for i in range(len(score))]
    return [(name, float(value)) for name, value in zip(names, score)]


def score_measures(df: DataFrame, scorer, target: str = "target", prediction: str = "prediction", id_col: str = "id") -> DataFrame:
    """(id, scores): ``scorer.score(target, prediction)`` of every pair, a score per type and of any shape."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = [[{"score_type": kind, "measure": name, "value": value}
                       for kind, score in scorer.score(t, p).items() for name, value in named_values(score)]
                      for t, p in zip(pdf[target], pdf[prediction])]
            yield pd.DataFrame({"id": pdf[id_col], "scores": pd.Series(scores, index=pdf.index, dtype=object)})

    return df.select(id_col, target, prediction).mapInPandas(run, PACKED)


def long_measures(packed: DataFrame) -> DataFrame:
    """(id, score_type, measure, value): one row per value."""
    return packed.select("id", F.inline("scores"))


def packed_scores(scores: DataFrame) -> DataFrame:
    """The score table of ``score_pairs`` (precision, recall, fmeasure) as rows of ``PACKED``, one per score type."""
    return scores.select("id", F.array(*[F.struct("score_type", F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
                                         for m in MEASURES]).alias("scores"))


def measure_report(packed: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """One row per pair: id and a column ``type-measure`` for each of ``columns`` (null where a pair has none)."""
    def one(kind: str, measure: str):
        found = F.filter("scores", lambda s: (s["score_type"] == kind) & (s["measure"] == measure))
        return F.get(found, 0)["value"].alias(f"{kind}-{measure}")

    return packed.select("id", *[one(*c) for c in columns])


def score_state(packed: DataFrame, n_samples: int = BOOTSTRAP_SAMPLES, seed: int = 0) -> DataFrame:
    """(score_type, measure, resample, weight, total, n_samples, seed): the state of these pairs."""
    check_params(0.5, n_samples)
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_samples + 3) // 4 - 1))).alias("blk")
    key = F.concat_ws("-", F.lit(f"{seed}-p"), F.col("id").cast("string"), F.col("blk").cast("string"))
    drawn = packed.select("id", "scores", blocks).select("scores", "blk", F.md5(key).alias("h"))
    drawn = drawn.select("scores", F.inline(_uniform_block(F.col("h"), "resample", F.col("blk"), n_samples)))
    drawn = drawn.where(F.col("resample") < n_samples).select("scores", "resample", poisson1_weight(F.col("u")).alias("w"))
    itself = packed.select("scores", F.lit(-1).cast("long").alias("resample"), F.lit(1.0).alias("w"))
    values = drawn.where("w > 0").unionByName(itself).select("resample", "w", F.inline("scores"))
    sums = values.groupBy(*_STATE).agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("value")).alias("total"))
    return sums.withColumns({"n_samples": F.lit(n_samples), "seed": F.lit(seed)})


def merge_states(states: list[DataFrame]) -> DataFrame:
    """The state of the pairs of all states; they must not share a pair."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy(*_STATE, "n_samples", "seed").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def add_scores(packed: DataFrame, folder: str, shard: str, n_samples: int = BOOTSTRAP_SAMPLES, seed: int = 0) -> None:
    """Add the state of a shard of pairs to ``folder``. A shard that is there already is refused, not added twice."""
    score_state(packed, n_samples, seed).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/shard={shard}")


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of all shards of ``folder``; shards of several sample numbers or seeds don't add up and raise."""
    shards = spark.read.parquet(folder)
    made = [tuple(r) for r in shards.select("n_samples", "seed").distinct().limit(2).collect()]
    if len(made) > 1:
        raise ValueError(f"shards of different draws (samples, seed): {sorted(made)}")
    return merge_states([shards.drop("shard")])


def state_intervals(state: DataFrame, confidence: float = BOOTSTRAP_CONFIDENCE) -> DataFrame:
    """(score_type, measure, mean, low, mid, high): the mean, and percentiles of the resamples' means."""
    check_params(confidence, 1)
    at = F.array(*[F.lit(q) for q in quantiles(confidence)])
    mean = F.when(F.col("weight") > 0, F.col("total") / F.col("weight"))
    again = F.when(F.col("resample") >= 0, mean)
    sums = state.groupBy("score_type", "measure").agg(
        F.max(F.when(F.col("resample") == -1, mean)).alias("mean"), F.percentile(again, at).alias("q"))
    return sums.select("score_type", "measure", "mean", *[F.get("q", i).alias(name) for i, name in enumerate(("low", "mid", "high"))])
