"""Aligning two sides that are numbered alike: files by rank, records by place.

``alignment_counts`` compares how many rows each side has per group,
``check_aligned`` raises where they differ, ``align`` pairs rows by their
numbers, and ``ordinals`` numbers rows within groups without a window over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.operators.ids import global_index, join_per_group


def alignment_counts(left: DataFrame, right: DataFrame, group: str, names: tuple[str, str]) -> DataFrame:
    """(group, rows of the left side, rows of the right side, ``aligned`` 0/1), for
    every group of either side. Counts are summed per task before the shuffle."""
    sides = left.select(group, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(group, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = sides.groupBy(group).agg(F.sum("_l").alias(names[0]), F.sum("_r").alias(names[1]))
    return counts.withColumn("aligned", (F.col(names[0]) == F.col(names[1])).cast("long"))


def role_counts(rows: DataFrame, group: str, sides: dict[str, Column]) -> DataFrame:
    """(group, rows of either side, ``aligned`` 0/1) where both sides are rows of one table: one scan of it."""
    left, right = sides
    counts = rows.groupBy(group).agg(*[F.count(F.when(on, 1)).alias(name) for name, on in sides.items()])
    counts = counts.where((F.col(left) > 0) | (F.col(right) > 0))
    return counts.withColumn("aligned", (F.col(left) == F.col(right)).cast("long"))


def check_aligned(counts: DataFrame, group: str, names: tuple[str, str], what: str) -> None:
    """Raise ``ValueError`` for the first group whose sides differ."""
    bad = counts.where("aligned = 0").orderBy(group).select(group, *names).first()
    if bad is not None:
        raise ValueError(f"{what} {bad[0]}: {bad[1]} {names[0]} but {bad[2]} {names[1]}")


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides with equal numbers, side by side (an equi-join)."""
    return left.join(right, keys)


def pair_by_rank(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """(rank, left name, right name): two lists of names (one column each, unique)
    paired in name order, as far as both go."""
    sides = [global_index(side, [name], "rank") for side, name in ((left, left_name), (right, right_name))]
    return align(sides[0].select("rank", left_name), sides[1].select("rank", right_name), ["rank"])


def ordinals(rows: DataFrame, group: list[str], place: str, name: str = "k") -> DataFrame:
    """``group``, ``place`` and the 0-based ordinal of ``place`` in its group.

    One global index over the keys alone and the first index per group: no text
    is sorted, and a group with a third of all rows is not one task."""
    indexed = global_index(rows.select(*group, place), [*group, place], "_gi")
    first = indexed.groupBy(*group).agg(F.min("_gi").alias("_first"))
    joined = join_per_group(indexed, first, group, salt_from=[F.col(place)])
    return joined.select(*group, place, (F.col("_gi") - F.col("_first")).alias(name))
