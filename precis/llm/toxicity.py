"""Toxicity by non-negative positive-unlabelled learning.

The classifier knows confirmed toxic texts and unlabelled ones only. With the
share of toxic texts (the class prior) the risk of calling an unlabelled text
clean is corrected for the toxic ones among them, and the corrected part is kept
from falling below zero, which would be overfitting.

The classifier is a logistic model over the presence of words and of word
beginnings (so that an unseen inflection of a toxic word counts). Its features are
those that tell toxic from clean in a bounded sample, in which copies of a toxic text
count once: no share of the sample is asked for and their number has no cap, so a rare
word counts as a frequent one does. They are counted and chosen by Spark; the driver
gets the chosen ones. Scoring covers whole texts in one narrow pass, and the model, of
a size bounded by the sample, is broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import quoted
from precis.session import written

#: Training rows at most: confirmed toxic ones and unlabelled ones.
POSITIVE_ROWS, UNLABELLED_ROWS = 4_000, 12_000
#: A feature speaks for toxic if it is in this many toxic texts and, by the class prior,
#: at least this share of the unlabelled texts with it should be toxic.
LEAST_TEXTS, LEAST_PRECISION = 4, 0.6
#: A feature speaks for clean if toxic texts have it less often by this many standard errors.
CLEAN_ERRORS = 4.0
#: Lengths of the word beginnings that are features as well.
PREFIXES = (4, 5)
STEPS, RATE, L2 = 200, 0.1, 2e-4
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """The distinct lower-cased words of a text and their beginnings (marked by ``^``)."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in PREFIXES:
        out.update(["^" + w[:n] for w in words if len(w) > n])
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        found = features(text) & self.weights.keys()
        z = self.bias + sum(self.weights[w] for w in sorted(found))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0))))


def telling(n_positive: int, n_unlabelled: int, prior: float) -> Column:
    """Which features are used, over counts ``in_p`` and ``in_u`` of the sample's texts with one."""
    n_p, n_u = max(1, n_positive), max(1, n_unlabelled)
    in_p, in_u = F.col("in_p"), F.col("in_u")
    toxic = (in_p >= LEAST_TEXTS) & (prior * in_p / n_p >= LEAST_PRECISION * (in_u + 1) / n_u)
    pooled = (in_p + in_u) / (n_p + n_u)
    error = F.sqrt(pooled * (1.0 - pooled) * (1.0 / n_p + 1.0 / n_u))
    clean = (error > 0) & (in_u / n_u - in_p / n_p >= CLEAN_ERRORS * error)
    return toxic | clean


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk for logistic loss.

    Rows are arrays of the columns that are present. Full-batch Adam with an L2
    penalty."""
    rows = positive + unlabelled
    ends = np.cumsum([len(r) for r in rows])
    flat = np.concatenate(rows) if len(ends) and ends[-1] else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_p = np.arange(len(rows)) < len(positive)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(owner, weights=w[flat], minlength=len(rows))
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        # risk of calling clean: over the unlabelled, less what the toxic among them add
        clean = np.logaddexp(0, z)
        negative = clean[~is_p].sum() / n_u - prior * clean[is_p].sum() / n_p
        slope = np.where(is_p, prior * (p - 1.0) / n_p, 0.0)
        correction = np.where(is_p, -prior * p / n_p, p / n_u)
        # below zero the corrected part is pushed up again instead of followed further down
        slope = slope + correction if negative >= 0 else -correction
        grad = np.append(np.bincount(flat, weights=slope[owner], minlength=size) + L2 * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        rate = RATE * (1.0 - step / (STEPS + 1.0))
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _part(ident: str) -> Column:
    """A fixed random number from 0 to 1 per id."""
    return F.pmod(F.xxhash64(F.col(ident).cast("string"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)


def _vocabulary(positive: DataFrame, unlabelled: DataFrame, prior: float) -> list[str]:
    """The features of the two samples that are used, in code point order."""

    @F.pandas_udf("array<string>")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(features(t)) for t in texts], dtype=object)

    both = positive.select("_text", F.lit(1).alias("p")).unionByName(unlabelled.select("_text", F.lit(0).alias("p")))
    counts = both.select(F.explode(distinct("_text")).alias("f"), "p").groupBy("f").agg(
        F.sum("p").alias("in_p"), F.sum(1 - F.col("p")).alias("in_u"))
    return sorted(r.f for r in counts.where(telling(positive.count(), unlabelled.count(), prior)).select("f").collect())


def _smallest(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes of id and text; repeated rows count once.

    Only hashes go through the sort; texts stay in their tasks until the row is chosen."""
    key = F.pmod(F.xxhash64(F.lit(7), "_id", "_text"), F.lit(1 << 62))
    share = min(1.0, 1.2 * most / max(1, rows.select("_id").count()))
    keyed = rows.withColumn("_key", key)
    # the whole range only where repeated rows leave too few in the first part
    for upto in (int(share * (1 << 62)), 1 << 62):
        found, cut = keyed.where(F.col("_key") <= upto).select("_key").distinct().orderBy("_key").limit(most).agg(
            F.count(F.lit(1)), F.max("_key")).first()
        if found == most:
            break
    return keyed.where(F.col("_key") <= (cut or 0)).groupBy("_key").agg(F.min(F.struct("_id", "_text")).alias("r")).select("r.*")


def _columns(rows: DataFrame, column: dict[str, int]) -> list[np.ndarray]:
    """Columns present in the rows of a sample, in a fixed order."""

    @F.pandas_udf("array<int>")
    def present(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(column[w] for w in features(t) & column.keys()) for t in texts], dtype=object)

    table = rows.select(present("_text").alias("at"), _part("_id").alias("part")).orderBy("part", "at").toPandas()
    return [np.asarray(r, dtype=np.int64) for r in table["at"]]


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          toxic_col: str = "toxic") -> ToxicityModel:
    """Fit on rows of ``docs`` for which ``learn`` (an expression over ``docs``) holds.

    Confirmed toxic are rows that ``labels`` marks 1; all rows serve as unlabelled.
    The prior is the share of ones among the labelled rows. Without a confirmed
    toxic text every score is the prior (0.01 at least)."""
    rows = docs.where(learn).select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    marks = labels.select(quoted(id_col).alias("_label_id"), quoted(toxic_col).alias("_toxic")).where(
        "_toxic is not null and _label_id is not null").groupBy("_label_id").agg(F.max("_toxic").alias("_toxic"))
    known = rows.select("_id").join(marks, F.col("_id") == F.col("_label_id"))
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.sum(F.col("_toxic").cast("long"))).first()
    prior = min(max((n_toxic or 0) / max(1, n_known), 0.01), 0.5)
    if not n_toxic:
        return ToxicityModel({}, float(np.log(prior / (1 - prior))))
    # the ids of the toxic sample are bounded, so they travel to the texts and not the other way
    toxic_ids = known.where("_toxic = 1").select("_label_id").distinct().orderBy(_part("_label_id"), "_label_id").limit(
        POSITIVE_ROWS)
    positive = rows.join(F.broadcast(toxic_ids), F.col("_id") == F.col("_label_id")).select("_id", "_text")
    # copies count once; the sample is bounded, so it may be kept
    positive = written(positive.groupBy(F.xxhash64("_text")).agg(F.min(F.struct("_id", "_text")).alias("r")).select("r.*"), "toxic")
    unlabelled = written(_smallest(rows, UNLABELLED_ROWS), "unlabelled")
    column = {f: i for i, f in enumerate(_vocabulary(positive, unlabelled, prior))}
    weights, bias = nnpu(_columns(positive, column), _columns(unlabelled, column), len(column), prior)
    return ToxicityModel({f: float(weights[i]) for f, i in column.items()}, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``).

    A null or wordless text gets the score of the bias alone; null ids stay null;
    repeated rows stay repeated; other columns are not read; an empty table gives
    an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    rows = docs.select(quoted(id_col).alias(id_col), scored(quoted(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
