"""Position-based splits and samples of an aligned pair table.

A split by position needs only the keys at its boundaries: they are found on
the key column alone (``keys_at``), and the rows are then told apart by comparing
their key, with no join and no shuffle of texts. The comparison reaches the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.constants import BY_LENGTH, DEFAULT_SPLIT_RATIO, TEST_TAG, TRAIN_TAG, VAL_TAG
from precis.operators.ids import keys_at


def _before(order_col: str, key) -> Column:
    """Rows ahead of the row with ``key`` (None: there is no such row, so all)."""
    return F.lit(True) if key is None else F.col(order_col) < F.lit(key)


def ratio_thresholds(n: int, ratio=DEFAULT_SPLIT_RATIO) -> tuple[float, float]:
    """Positions (not rounded) at which the validation and the test part begin."""
    whole = float(sum(ratio))
    first = ratio[0] / whole * n
    return first, first + ratio[1] / whole * n


def ratio_split(df: DataFrame, order_col: str = "id", ratio=DEFAULT_SPLIT_RATIO) -> DataFrame:
    """``split`` = train for positions < r0*n, val below (r0+r1)*n, else test
    (ratio normalised; a zero share gets no rows)."""
    val, test = (math.ceil(t) for t in ratio_thresholds(df.count(), ratio))
    first_val, first_test = keys_at(df, order_col, [val, test])
    split = F.when(_before(order_col, first_val), TRAIN_TAG).when(_before(order_col, first_test), VAL_TAG)
    return df.withColumn("split", split.otherwise(TEST_TAG))


def size_split(df: DataFrame, train_size: int, test_size: int, order_col: str = "id", overlap: bool = False) -> DataFrame:
    """First ``train_size`` rows -> train, next ``test_size`` -> test, rest -> valid.

    ``overlap=True`` reproduces the head/tail script exactly: ``tail -n +N`` is
    1-based, so the N-th row is in train and test, and row N+M-1 in test and
    valid (the result has two duplicated rows)."""
    ranks = [train_size, train_size + test_size, train_size - 1, train_size - 1 + test_size, train_size + test_size - 2]
    key = dict(zip(ranks, keys_at(df, order_col, [max(0, r) for r in ranks])))
    ahead = {r: _before(order_col, key[r]) for r in ranks}
    if not overlap:
        split = F.when(ahead[train_size], "train").when(ahead[train_size + test_size], "test").otherwise("valid")
        return df.withColumn("split", split)
    train = F.when(ahead[train_size], F.lit("train"))
    test = F.when(~ahead[train_size - 1] & ahead[train_size - 1 + test_size], F.lit("test"))
    valid = F.when(~ahead[train_size + test_size - 2], F.lit("valid"))
    return df.withColumn("split", F.explode(F.array_compact(F.array(train, test, valid))))


def head_tail(df: DataFrame, n: int, order_col: str = "id") -> DataFrame:
    """``part`` = head for the first n rows, tail for the rest."""
    return df.withColumn("part", F.when(_before(order_col, keys_at(df, order_col, [n])[0]), "head").otherwise("tail"))


def byte_length_predicate(article_col: str, max_length: int):
    """Keep iff the article's UTF-8 length including its newline is < max_length."""
    return (F.octet_length(F.col(article_col)) + 1) < F.lit(max_length)


def sample_pairs(df: DataFrame, method: str = BY_LENGTH, article_col: str = "article", **kwargs) -> DataFrame:
    if method != BY_LENGTH:
        raise NotImplementedError(f"unknown sampling method {method!r}; there is {BY_LENGTH!r}")
    if BY_LENGTH not in kwargs:
        raise KeyError(BY_LENGTH)
    return df.where(byte_length_predicate(article_col, kwargs[BY_LENGTH]))


def sample_share(df: DataFrame, max_length: int, article_col: str = "article") -> DataFrame:
    """One row: kept, total and kept/total*100 rounded to 2 places (null when empty)."""
    keep = byte_length_predicate(article_col, max_length)
    agg = df.agg(F.sum(F.when(keep, 1).otherwise(0)).cast("long").alias("kept"), F.count("*").alias("total"))
    return agg.select(
        F.coalesce(F.col("kept"), F.lit(0)).cast("long").alias("kept"),
        "total",
        F.round(F.when(F.col("total") > 0, F.col("kept") / F.col("total") * 100), 2).alias("share"),
    )
