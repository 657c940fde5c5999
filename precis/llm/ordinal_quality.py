"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades, and ordered
thresholds cut its score: P(grade <= k) is the logistic of threshold k less the
score. The expected grade and the probability of the top grades then serve
selection. Training uses a bounded sample of rated rows; scoring is one narrow
pass over whole texts with a broadcast model of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import quoted
from precis.llm.text_hash import word_ngram_buckets
from precis.session import discard, written

#: Buckets of hashed features (2**16), and rows of the training sample at most.
BITS, SAMPLE_ROWS = 16, 12_000
STEPS, RATE, L2 = 200, 0.05, 1e-4
#: Rows whose features a step of the fit handles at once.
CHUNK_ROWS = 500
#: Parts in which the sample comes to the driver.
SLICES = 24


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than the grades

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        at, value = features(text)
        return _logistic(float(self.weights[at] @ value) - self.thresholds)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): log counts of hashed word n-grams, scaled to length one."""
    at, n = np.unique(word_ngram_buckets(text, BITS), return_counts=True)
    value = np.log1p(n.astype(np.float64))
    return at, value / max(float(np.sqrt(value @ value)), 1e-12)


@dataclass
class Features:
    """Features of rows, flat: those of row i lie from ``starts[i]`` to ``starts[i + 1]``."""

    at: np.ndarray  # uint16
    value: np.ndarray  # float32
    starts: np.ndarray

    def chunks(self):
        """(first row, row past the last, buckets, values, place of each row's first feature)."""
        rows = len(self.starts) - 1
        for a in range(0, rows, CHUNK_ROWS):
            b = min(a + CHUNK_ROWS, rows)
            cut = slice(self.starts[a], self.starts[b])
            yield a, b, self.at[cut], self.value[cut], self.starts[a:b + 1] - self.starts[a]

    def scores(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.starts) - 1)
        for a, b, at, value, starts in self.chunks():
            if len(at):
                # rows without features: reduceat would give them a neighbour's feature
                some = np.diff(starts) > 0
                out[a:b][some] = np.add.reduceat(w[at] * value, starts[:-1][some])
        return out

    def slopes(self, by_row: np.ndarray) -> np.ndarray:
        """Sum of ``by_row`` times the values, per bucket."""
        out = np.zeros(1 << BITS)
        for a, b, at, value, starts in self.chunks():
            out += np.bincount(at, weights=np.repeat(by_row[a:b], np.diff(starts)) * value, minlength=1 << BITS)
        return out


def flat(rows) -> Features:
    """Rows of (bytes of uint16 buckets, bytes of float32 values), each let go as it is taken in."""
    at, value, sizes = bytearray(), bytearray(), [0]
    for a, v in rows:
        at += a
        value += v
        sizes.append(len(a) // 2)
    return Features(np.frombuffer(at, dtype=np.uint16), np.frombuffer(value, dtype=np.float32), np.cumsum(sizes))


def fit(x: Features, grades: np.ndarray, levels: int) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by full-batch Adam. Thresholds are a
    first one plus positive steps, so that they stay in order."""
    n = len(grades)
    size = 1 << BITS
    shares = np.cumsum(np.bincount(grades, minlength=levels))[:-1] + 1.0
    first = np.log(shares / (len(grades) + 2.0 - shares))
    first = np.maximum.accumulate(first + 1e-3 * np.arange(levels - 1))
    params = np.concatenate((np.zeros(size), first[:1], np.log(np.maximum(np.diff(first), 1e-3))))
    m, v = np.zeros_like(params), np.zeros_like(params)
    k = np.arange(levels - 1)
    for step in range(1, STEPS + 1):
        w, cuts = params[:size], params[size] + np.concatenate(([0.0], np.cumsum(np.exp(params[size + 1:]))))
        score = x.scores(w)
        below = _logistic(cuts[None, :] - score[:, None])  # P(grade <= k)
        edges = np.concatenate((np.zeros((n, 1)), below, np.ones((n, 1))), axis=1)
        p = np.maximum(edges[np.arange(n), grades + 1] - edges[np.arange(n), grades], 1e-9)
        # the likelihood of a grade depends on the cuts above (+) and below (-) it
        side = (grades[:, None] == k[None, :]).astype(float) - (grades[:, None] - 1 == k[None, :])
        slope = -side * below * (1 - below) / p[:, None] / n
        by_cut = slope.sum(axis=0)
        grad_w = x.slopes(-slope.sum(axis=1)) + L2 * w
        later = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate((grad_w, later[:1], later[1:] * np.exp(params[size + 1:])))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return OrdinalModel(params[:size].copy(), params[size] + np.concatenate(([0.0], np.cumsum(np.exp(params[size + 1:])))))


def train(docs: DataFrame, ratings: DataFrame, levels: int, learn: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> OrdinalModel:
    """Fit on rows of ``docs`` rated in ``ratings`` (id, ``grade`` 0 to levels - 1).

    Null ids and grades teach nothing; of several grades of an id the lowest
    counts. Without ratings every threshold is at even odds, in order."""
    part = F.pmod(F.xxhash64(F.col("_rated").cast("string"), F.lit(11)), F.lit(1 << 30))
    rated = ratings.select(quoted(id_col).alias("_rated"), F.col("grade").cast("int").alias("_grade"))
    rated = rated.where("_rated is not null and _grade is not null").groupBy("_rated").agg(F.min("_grade").alias("_grade"))
    rated = rated.where(learn) if learn is not None else rated
    # only ids that have a document count towards the sample, and a bounded number of them travels to the texts
    ids = docs.select(quoted(id_col).alias("_id"))
    rated = rated.join(ids, F.col("_rated") == F.col("_id"), "left_semi")
    rated = rated.orderBy(part, "_rated").limit(SAMPLE_ROWS)

    @F.pandas_udf("at binary, value binary")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        found = [features(t) for t in texts]
        return pd.DataFrame({"at": [a.astype(np.uint16).tobytes() for a, _ in found],
                             "value": [v.astype(np.float32).tobytes() for _, v in found]})

    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    rows = rows.join(F.broadcast(rated), F.col("_id") == F.col("_rated"))
    table = rows.select("_grade", hashed("_text").alias("x"), part.alias("part")).select("_grade", "x.*", "part")
    table = written(table, "rated-sample")
    ordered = table.repartitionByRange(SLICES, "part").sortWithinPartitions("part")
    grades: list[int] = []

    def taken():
        # one part after the other, in order: the driver's JVM holds no more than one
        for r in islice(ordered.toLocalIterator(), SAMPLE_ROWS):
            grades.append(r["_grade"])
            yield r["at"], r["value"]

    x = flat(taken())
    discard(table)
    if not grades:
        return OrdinalModel(np.zeros(1 << BITS), np.linspace(-1.0, 1.0, levels - 1) if levels > 2 else np.zeros(levels - 1))
    return fit(x, np.clip(np.array(grades), 0, levels - 1), levels)


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text",
                    top: int | None = None, select_from: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, ``expected_grade``, ``tail`` = P(grade >=
    ``top``, the highest by default) and ``selected`` (tail from ``select_from``).

    A null or wordless text has no features and gets the grades' base rates; null
    ids stay null; repeated rows stay repeated; other columns are not read; an
    empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    top = len(model.thresholds) if top is None else top

    @F.pandas_udf("expected_grade double, tail double")
    def graded(texts: pd.Series) -> pd.DataFrame:
        above = [shared.value.above(t) for t in texts]
        return pd.DataFrame([(float(a.sum()), float(a[top - 1])) for a in above], columns=["expected_grade", "tail"])

    rows = docs.select(quoted(id_col).alias("_id"), graded(quoted(text_col)).alias("_g"))
    return rows.select(F.col("_id").alias(id_col), "_g.*", (F.col("_g.tail") >= select_from).alias("selected"))
