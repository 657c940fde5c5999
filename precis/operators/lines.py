"""User functions over lines and pluggable scorers (the UDF surface).

``map_lines``: apply ``worker(line, *payload)`` to every line of a line
table with ``mapInPandas``; ``None`` results are dropped and the columns that
number a line are kept, so ordered output is a sort by them at the sink.

``score_with``: any object with ``score(target, prediction) -> {type: (p, r, f)}``
is run per pair in ``mapInPandas`` and produces the long score table. Scores of
another shape are for ``measures.score_measures``.
"""

from __future__ import annotations

from typing import Callable, Iterator, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.operators.rouge import SCORE_SCHEMA


def map_lines(df: DataFrame, worker: Callable, *payload, line_col: str = "value", id_col="line",
              out_col: str = "value") -> DataFrame:
    """``id_col`` is one column or several (such as file, line, sub-line)."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    rows = df.select(*ids, F.col(line_col).alias("_line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[ids].copy()
            out[out_col] = pd.Series([worker(v, *payload) for v in pdf["_line"]], index=pdf.index, dtype=object)
            yield out[out[out_col].notna()]

    return rows.mapInPandas(run, T.StructType(rows.schema.fields[:-1] + [T.StructField(out_col, T.StringType())]))


class Scorer(Protocol):
    def score(self, target: str, prediction: str) -> dict: ...


def score_with(df: DataFrame, scorer: Scorer, target: str = "target", prediction: str = "prediction",
               id_col: str = "id") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, p in zip(pdf[id_col], pdf[target], pdf[prediction]):
                for ty, s in scorer.score(t, p).items():
                    if len(s) != 3:
                        raise ValueError(f"{ty}: {len(s)} measures instead of precision, recall and fmeasure; use score_measures")
                    rows.append((int(i), ty, float(s[0]), float(s[1]), float(s[2])))
            yield pd.DataFrame(rows, columns=["id", "score_type", "precision", "recall", "fmeasure"])

    return df.select(F.col(id_col), F.col(target), F.col(prediction)).mapInPandas(run, SCORE_SCHEMA)
