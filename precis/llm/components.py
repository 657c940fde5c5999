"""Connected components of a link table, by alternating star contractions.

Each round hangs every node's larger neighbours on its smallest one (large
star), then every node's smaller neighbours (small star), until all links point
straight at the smallest node of their component; the number of rounds grows
with the logarithm of the longest path. Rounds are written to the shared folder
and the one before is deleted. The driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.session import discard, written


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return int(row[0]), int(row[1] or 0)


def component_roots(links: DataFrame) -> DataFrame:
    """(a, b) links of comparable nodes to one row per linked node: ``node`` and
    ``root``, the smallest node of its component (roots themselves not listed).

    Links may repeat, point either way and be loops; no links give no rows."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = written(links.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written, so that their joins don't inherit the grouping and the links of a hub can be split
        lowest = written(ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        large = ends.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "links")
        discard(lowest)
        lowest = written(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        hung = large.join(lowest, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        small = written(hung.select("l.*").where("a <> b").distinct(), "links")
        for table in (now, large, lowest):
            discard(table)
        now, before = small, state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
