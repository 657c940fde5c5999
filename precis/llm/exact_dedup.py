"""Exact deduplication by progressive refinement.

Documents are grouped by length, then by a hash of their first characters
(both in one scan, as a group of the second kind lies in one of the first); only
documents of groups with two or more members have their whole content hashed,
and only equal digests of equal lengths are copies.

The groups that survive reach the second scan as a bitmap of fixed size, so no
text is shuffled to find them, whatever their number. Everything that is
grouped or joined is narrow (id, length, two hashes), copies are counted map-side
first, and the join that hands a group's result back to its members is one that
adaptive execution may split, as nothing after it needs the key together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import key_bitmap, maybe_in, quoted
from precis.session import written

#: Characters of a text that the second level hashes.
PREFIX_CHARS = 512
#: The bitmap of surviving groups has 2**27 bits (16 MB).
BITMAP_BITS_LOG2 = 27

_KEY = ["_len", "_prefix", "_digest"]


def _levels(text: Column) -> tuple[Column, Column, Column]:
    """Length, prefix hash and the hash of both, by which the bitmap is looked up."""
    size = F.octet_length(text).cast("long")
    prefix = F.xxhash64(F.substring(text, 1, PREFIX_CHARS))
    return size, prefix, F.xxhash64(size, prefix)


def _survivors(docs: DataFrame, text: Column) -> DataFrame:
    """The bitmap of (length, prefix hash) groups with two or more documents."""
    size, prefix, both = _levels(text)
    groups = docs.select(size.alias("_len"), prefix.alias("_prefix"), both.alias("_both"))
    groups = groups.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n"), F.first("_both").alias("_both"))
    return key_bitmap(groups.where("_n > 1"), "_both", BITMAP_BITS_LOG2)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id`` (the largest id of equal
    texts), ``group_size`` and ``kept``; ``carry`` adds expressions over ``docs``.

    Texts are equal when they are identical; null counts as empty. Exactly one
    row of a group is kept: of repeated rows with the largest id one, and a null
    id ranks below every other. Other columns are not read, so their names don't
    matter; an empty table gives an empty result. ``docs`` is scanned twice."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    carry = carry or {}
    size, prefix, both = _levels(text)
    rows = docs.select(
        quoted(id_col).alias("_id"), text.alias("_text"), size.alias("_len"), prefix.alias("_prefix"),
        both.alias("_both"), *[e.alias(f"_c{i}") for i, e in enumerate(carry.values())])
    rows = maybe_in(rows, "_both", _survivors(docs, text), BITMAP_BITS_LOG2, "_maybe")
    extra = [f"_c{i}" for i in range(len(carry))]
    rows = rows.select("_id", "_len", "_prefix", F.when(F.col("_maybe"), F.sha2("_text", 256)).alias("_digest"), *extra)
    # repeated rows become one with their number before anything is grouped by content
    rows = written(rows.groupBy("_id", *_KEY, *extra).agg(F.count(F.lit(1)).alias("_n")), "exact-dedup")
    groups = rows.where("_digest is not null").groupBy(*_KEY).agg(
        F.max("_id").alias("_keep"), F.sum("_n").alias("_size"))
    # written, so that the join doesn't inherit the grouping's partitions and a large one can be split
    found = rows.join(written(groups.where("_size > 1"), "exact-groups"), _KEY, "left")
    alone = F.col("_size").isNull()
    copies = found.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", "_n").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_nth"),
        *[F.col(f"_c{i}").alias(name) for i, name in enumerate(carry)])
    kept = quoted(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)
    return copies.select(id_col, "keep_id", "group_size", kept.alias("kept"), *[quoted(c) for c in carry])


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows outside the surviving groups pass straight through; only the others are
    shuffled, by content and id together, so a large group of copies spreads over
    all tasks. Of equal texts the row with the largest id stays, one with a null id only
    where all of them are null; of repeated rows with one id and text one stays. Null texts
    count as empty; an empty table gives an empty result. ``docs`` is scanned four times: pass a stored table."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    size, prefix, both = _levels(text)
    marked = docs.select(
        # one struct holds the row, so that its column names can't clash with the plan's
        F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), quoted(id_col).alias("_id"), text.alias("_text"),
        size.alias("_len"), prefix.alias("_prefix"), both.alias("_both"))
    marked = maybe_in(marked, "_both", _survivors(docs, text), BITMAP_BITS_LOG2, "_maybe")
    rest = marked.where("_maybe").select("_row", "_id", "_len", "_prefix", F.sha2("_text", 256).alias("_digest"))
    stay = rest.groupBy(*_KEY).agg(F.max("_id").alias("_id"))
    same = [F.col(f"r.{k}") == F.col(f"s.{k}") for k in _KEY] + [F.col("r._id").eqNullSafe(F.col("s._id"))]
    chosen = rest.alias("r").join(stay.alias("s"), same).select("_row", *[F.col(f"r.{k}") for k in _KEY])
    through = marked.where(~F.col("_maybe")).select("_row")
    return through.unionByName(chosen.dropDuplicates(_KEY).select("_row")).select("_row.*")
