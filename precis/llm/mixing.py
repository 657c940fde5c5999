"""Mixing sources to target weights.

Every source gets a share of the wanted total by its weight, at most
``max_epochs`` times its own size; what a full source can't take is shared anew.
A source's documents are put in a hash-random order; whole passes (epochs) are
taken while the target allows, and the last pass is cut where the running sum of
sizes meets the rest of the target (a document is taken whole, so the cut is the
document boundary nearest to it).

The order is a range sort by (source, random key), so that a source with a third
of all rows spreads over many tasks; the running sum is one of per-partition
totals and, inside the one partition per source where the cut falls, of rows.
What the rows get back is one cut per source: no text is ever shuffled. The
driver sees two numbers a round while targets are settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import fresh, quoted
from precis.operators.ids import global_index
from precis.session import written

SHARE, MAX_EPOCHS, WEIGHTS, SEED = 1.5, 2, (3, 1, 2), 1
#: Sources up to this number are broadcast with their cuts (some 100 bytes each).
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.translate(gaps, " \t\n\x0b\x0c\r", "")).cast("long")


def random_key(ident: Column, seed: int) -> Column:
    """60 random bits of an id (null: of the empty string), equal on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(``_source``, ``source_size``) to the same plus ``target``.

    Sources by code point, null last, get ``weights`` in turn. Settling: a source
    whose part of what is left lies above ``max_epochs`` times its size stops
    there; the level of the others only rises, so rounds end when no more stop."""
    ranked = global_index(sizes.withColumn("_none", F.col("_source").isNull()), ["_none", "_source"], "_rank")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = written(ranked.select("_source", "source_size", turn.cast("long").alias("_weight"),
                                  (F.col("source_size") * max_epochs).alias("_most")), "sources")
    total, weight = table.agg(F.sum("source_size"), F.sum("_weight")).first()
    left, weight = share * (total or 0), weight or 1
    wanted = left

    def over(rest: float, parts: int) -> Column:
        return F.col("_most") * F.lit(float(parts)) < F.col("_weight") * F.lit(float(rest))

    while True:
        stop = over(left, weight)
        most, parts = table.agg(F.sum(F.when(stop, F.col("_most")).otherwise(0)),
                                F.sum(F.when(stop, 0).otherwise(F.col("_weight")))).first()
        settled = (wanted - (most or 0), parts or 0)
        if settled == (left, weight) or not settled[1]:
            break
        left, weight = settled
    part = F.col("_weight") * F.lit(float(left)) / F.lit(float(weight))
    return table.select("_source", "source_size",
                        F.when(over(left, weight), F.col("_most").cast("double")).otherwise(part).alias("target"))


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, alike: Column) -> DataFrame:
    ident = quoted(id_col)
    return docs.select(ident.alias("_id"), quoted(source_col).alias("_source"), random_key(ident, seed).alias("_key"),
                       word_count(quoted(text_col)).alias("_size"), alike.alias("_alike"))


def _order() -> Column:
    """The place of a row in its source; rows of one place are alike."""
    return F.struct("_key", F.col("_id").cast("string").alias("_id"), "_size", "_alike")


def source_cuts(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: size, target, whole ``_passes``, and where the last pass ends: ``_last`` (the last
    place in) or else ``_out`` (the first place out). Of the ``_of`` rows of the last place ``_in`` are in."""
    sorted_rows = rows.where("_size > 0").withColumn("_place", _order()).repartitionByRange("_source", "_place")
    sorted_rows = written(sorted_rows.select("_source", "_place", F.spark_partition_id().alias("_part")), "mix-order")
    size = F.col("_place._size")
    parts = written(sorted_rows.groupBy("_source", "_part").agg(F.sum(size).alias("_sum")), "mix-parts")
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("_passes", passes.cast("long"))
    targets = targets.withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    # the cut lies in the partition that holds the word at the rest of the target
    edge = parts.alias("p").join(targets.alias("t"), F.col("p._source").eqNullSafe(F.col("t._source"))).where(
        "_before <= _rest and _rest < _before + _sum").select("p._source", "_part", "_before", "_rest")
    edge = edge.withColumnsRenamed({"_source": "_edge", "_part": "_edge_part"})
    near = sorted_rows.join(edge, F.col("_source").eqNullSafe(F.col("_edge")) & (F.col("_part") == F.col("_edge_part")))
    upto = Window.partitionBy("_source", "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum(size).over(upto), F.lit(0))
    near = near.withColumn("_in", 2 * ahead + size <= 2 * F.col("_rest"))
    # rows of one place are counted first: the cut may fall among them
    places = near.groupBy("_source", "_place").agg(F.sum(F.col("_in").cast("long")).alias("in"), F.count(F.lit(1)).alias("of"))
    last = F.max(F.when(F.col("in") > 0, F.struct("_place", "in", "of")))
    cuts = places.groupBy("_source").agg(last.alias("l"), F.min(F.when(F.col("in") == 0, F.col("_place"))).alias("_out"))
    return targets.alias("t").join(cuts.alias("c"), F.col("t._source").eqNullSafe(F.col("c._source")), "left").select(
        "t._source", "source_size", "target", "_passes", F.col("l._place").alias("_last"), "_out",
        F.col("l.in").alias("_in"), F.col("l.of").alias("_of"))


def _with_copies(rows: DataFrame, cuts: DataFrame, name: str, held: list[str]) -> DataFrame:
    """``held`` columns of ``rows`` (which have ``_source``, ``_place`` and ``_size``) plus how often each is taken.

    Few sources (the number is counted) are broadcast; otherwise the join is one
    that adaptive execution may split where a source is large. Rows of a place in which
    the cut falls are alike: one stands for all of them until it is repeated."""
    cuts = written(cuts, "cuts")
    side = cuts.withColumnRenamed("_source", "_cut_source")
    if cuts.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    place = F.col("_place")
    joined = rows.join(side, F.col("_source").eqNullSafe(F.col("_cut_source")), "left")
    inside = F.coalesce(place <= F.col("_last"), place < F.col("_out"), F.lit(False))
    copies = F.when(F.col("_size") > 0, F.col("_passes") + inside.cast("long")).otherwise(F.lit(0))
    if cuts.where("_in < _of").isEmpty():
        return joined.select(*held, copies.alias(name))
    parted = F.coalesce((place == F.col("_last")) & (F.col("_in") < F.col("_of")), F.lit(False))
    whole = joined.where(~parted).select(*held, copies.alias(name))
    few = joined.where(parted).groupBy("_source", "_place").agg(
        F.first(F.struct(*held)).alias("_one"), F.first("_passes").alias("_passes"), F.first("_in").alias("_in"), F.count(F.lit(1)).alias("_of"))
    # the number of rows is that of the table; they are made block by block
    block = F.lit(1 << 16)
    blocks = few.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_of") - 1) / block))).alias("_block"))
    nth = F.explode(F.sequence(F.col("_block") * block, F.least(F.col("_of"), (F.col("_block") + 1) * block) - 1)).alias("_nth")
    again = blocks.select("_one", "_passes", "_in", nth)
    return whole.unionByName(again.select("_one.*", (F.col("_passes") + (F.col("_nth") < F.col("_in")).cast("long")).alias(name)))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` in words, ``source_size``,
    ``target`` of its source and ``taken``, its words in the mix, repeats counted.

    ``taken`` is a whole multiple of ``size``, at most ``max_epochs`` times it. A
    null or wordless text has size 0 and takes nothing. Null is a source of its own,
    null ids are ids of one value; of repeated rows at the cut as many are taken as fit.
    Other columns are not read; an empty table gives an empty result. Runs agree
    whatever the partitioning."""
    rows = written(_rows(docs, id_col, source_col, text_col, seed, F.xxhash64(quoted(text_col))), "sizes")
    cuts = source_cuts(rows, weights, share, max_epochs)
    out = _with_copies(rows.withColumn("_place", _order()), cuts, "_copies", ["_id", "_size", "source_size", "target"])
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
                      (F.col("_size") * F.col("_copies")).alias("taken"))


def repeat_to_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                  weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Odd rows as in ``mix_sources``: a null or wordless text is not taken, null is a
    source of its own, and of rows equal in all columns as many are taken as fit. An
    empty table gives an empty result."""
    # maps have no hash: their JSON stands for them
    alike = F.xxhash64(*[F.to_json(F.struct(quoted(f.name))) if "map<" in f.dataType.simpleString() else quoted(f.name)
                         for f in docs.schema.fields])
    rows = written(_rows(docs, id_col, source_col, text_col, seed, alike), "sizes")
    cuts = source_cuts(rows, weights, share, max_epochs)
    # one struct holds the row, so that its column names can't clash with the plan's
    held = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), quoted(id_col).alias("_id"),
                       quoted(source_col).alias("_source"), random_key(quoted(id_col), seed).alias("_key"),
                       word_count(quoted(text_col)).alias("_size"), alike.alias("_alike"))
    taken = _with_copies(held.withColumn("_place", _order()), cuts, "_copies", ["_row"]).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_nth")).select("_row.*")
