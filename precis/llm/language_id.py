"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams, scaled to length one.
Document frequencies are counted over all rows to learn from. The weights are
trained on a bounded sample by follow-the-regularised-leader with an elastic-net
penalty (so most of them are exactly zero), and the softmax is calibrated by one
temperature on rows of the sample that were held back. Scoring is a narrow pass
over whole texts in Arrow batches; the model has a fixed size and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import quoted
from precis.llm.text_hash import char_ngram_buckets

#: Longest n-gram, and buckets (2**14).
LONGEST, BITS = 3, 14
#: Rows of the training sample, shared evenly between the languages, and the least number for each of very many.
SAMPLE_ROWS, LEAST_EACH, EPOCHS, CALIBRATION_SHARE = 4_000, 8, 4, 0.2
#: Learning rate, its smoothing, and the elastic-net penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray  # per bucket
    weights: np.ndarray  # languages x buckets
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> np.ndarray:
        return tfidf(char_ngram_buckets(text, LONGEST, BITS), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); ``und`` and 0 without a letter or a model."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        p = softmax((self.weights @ self.features(text) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def tfidf(grams: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.bincount(grams, minlength=1 << BITS).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """(documents, documents per bucket) over all rows of ``docs``; a task hands
    on one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, dtype=np.int64)  # the last entry: documents
        for batch in batches:
            for text in batch.column(0):
                seen = np.bincount(char_ngram_buckets(text.as_py(), LONGEST, BITS), minlength=1 << BITS) > 0
                total[:-1] += seen
                total[-1] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    counts = docs.select(quoted(text_col).alias("text")).mapInArrow(count, "bucket int, n long")
    table = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # 2**BITS + 1 rows at most
    out = np.zeros((1 << BITS) + 1, dtype=np.int64)
    out[table.bucket] = table.n
    return int(out[-1]), out[:-1]


def training_sample(docs: DataFrame, lang_col: str, text_col: str, key: Column) -> pd.DataFrame:
    """(lang, n-gram buckets and counts) of about ``SAMPLE_ROWS`` rows, picked by hash evenly over all
    languages; with more than ``SAMPLE_ROWS / LEAST_EACH`` of them, ``LEAST_EACH`` rows for each. The
    bound holds exactly: the sample is cut to it, by the place in a language's share, so none is cut off."""
    rows = docs.select(quoted(lang_col).alias("lang"), quoted(text_col).alias("text"), key.alias("key")).where("text <> ''")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    most = max(SAMPLE_ROWS, LEAST_EACH * len(sizes))
    each = 1.2 * most / max(1, len(sizes))
    share = rows.sparkSession.createDataFrame([(r.lang, min(1.0, each / r.n)) for r in sizes], "lang string, share double")
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(share), "lang").where(part < F.col("share"))
    # the exact cut is by the place within the language's share, so that it is even as well
    picked = picked.select("lang", "text", (part / F.col("share")).alias("place"))

    @F.pandas_udf("gram array<int>, n array<int>")
    def grams(texts: pd.Series) -> pd.DataFrame:
        found = [np.unique(char_ngram_buckets(t, LONGEST, BITS), return_counts=True) for t in texts]
        return pd.DataFrame({"gram": [g.astype(np.int32) for g, _ in found], "n": [n.astype(np.int32) for _, n in found]})

    out = picked.select("lang", grams("text").alias("g"), "place").select("lang", "g.gram", "g.n", "place")
    return out.orderBy("place", "lang").limit(most).toPandas()


def train(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Fit on the rows of ``docs`` with a language (null languages and empty texts teach nothing)."""
    docs = docs.where(quoted(lang_col).isNotNull())
    n, df = document_frequencies(docs, text_col)
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32) + np.float32(0.1)
    sample = training_sample(docs, lang_col, text_col, quoted(id_col).cast("string"))
    languages = sorted(sample.lang.unique())
    if not languages:
        return LanguageModel([], idf, np.zeros((0, 1 << BITS), dtype=np.float32), np.zeros(0, dtype=np.float32))
    y = np.array([languages.index(x) for x in sample.lang])
    x = []
    for gram, count in zip(sample.gram, sample.n):
        gram, value = np.asarray(gram), np.log1p(np.asarray(count, dtype=np.float32)) * idf[np.asarray(gram)]
        x.append((gram, value / max(float(np.sqrt(value @ value)), 1e-12)))
    fit = max(1, int(len(x) * (1 - CALIBRATION_SHARE)))
    weights, bias = ftrl(x[:fit], y[:fit], len(languages))
    model = LanguageModel(languages, idf, weights, bias)
    held = range(fit, len(x)) if fit < len(x) else range(len(x))
    logits = np.array([weights[:, g] @ v + bias for g, v in (x[i] for i in held)])
    model.temperature = calibrate(logits, y[list(held)])
    return model


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x buckets) and bias by per-coordinate
    follow-the-regularised-leader, rows in a fixed shuffled order per epoch."""
    z = np.zeros((classes, (1 << BITS) + 1))
    n = np.zeros_like(z)

    def leader(at) -> np.ndarray:
        zi, ni = z[:, at], n[:, at]
        l1 = np.where(np.asarray(at) == 1 << BITS, 0.0, L1)  # the bias is not penalised
        w = -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            at = np.append(x[i][0], 1 << BITS)
            value = np.append(x[i][1], 1.0)
            w = leader(at)
            error = softmax(w @ value)
            error[y[i]] -= 1.0
            g = error[:, None] * value[None, :]
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    w = leader(np.arange((1 << BITS) + 1)).astype(np.float32)
    return w[:, :-1], w[:, -1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by a grid on a log scale."""
    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean())

    return float(min(np.exp(np.linspace(np.log(0.02), np.log(20.0), 120)), key=loss))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred`` and ``score``.

    Null texts and texts without a letter are ``und`` with score 0; null ids stay
    null; repeated rows stay repeated; other columns are not read; an empty table
    gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    rows = docs.select(quoted(id_col).alias("_id"), predicted(quoted(text_col)).alias("_p"))
    return rows.select(F.col("_id").alias(id_col), "_p.*")
