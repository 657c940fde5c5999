"""Vocabulary building and corpus encoding.

``build_vocabulary``: explode tokens -> count per token (partial counts per
task, so a token that is a third of the corpus is pre-aggregated before the
shuffle) -> dense ids by (count desc, token asc) with ``global_index``
(range-partitioned sort, no single-task window).

``encode``: token -> id through ``map_tokens``. With ``out_col`` the tokens' own column
they are not carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.functions.tokens import explode_tokens
from precis.operators.ids import global_index, join_per_group
from precis.operators.lookup import map_tokens


def build_vocabulary(df: DataFrame, tokens_col: str = "tokens", min_count: int = 1, id_offset: int = 0,
                     by: str | None = None) -> DataFrame:
    """(token, count, id); with ``by`` one vocabulary per value of that column
    (side, language), ranked in one sort: ids restart at 0 for every value."""
    keep = [by] if by else []
    counts = (
        explode_tokens(df, tokens_col, "token", keep=keep)
        .groupBy(*keep, "token")
        .agg(F.count("*").alias("count"))
        .where(F.col("count") >= min_count)
    )
    order = [F.col(by)] if by else []
    indexed = global_index(counts, order + [F.col("count").desc(), F.col("token").asc()], "id")
    if by:
        first = indexed.groupBy(by).agg(F.min("id").alias("_first"))
        indexed = join_per_group(indexed, first, by, salt_from=[F.col("id")])
        indexed = indexed.withColumn("id", F.col("id") - F.col("_first"))
    return indexed.select(*keep, "token", "count", (F.col("id") + F.lit(id_offset)).alias("id"))


def encode(df: DataFrame, tokens_col: str, vocab: DataFrame, unk_id: int = -1, out_col: str = "ids",
           way: str | None = None) -> DataFrame:
    return map_tokens(df, tokens_col, vocab, "token", "id", default=unk_id, out_col=out_col, way=way, ranked=True)
