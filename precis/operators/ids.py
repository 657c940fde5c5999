"""Dense positions and per-group attachments without a single-task step.

* ``global_index`` numbers rows 0..n-1 in a total order. It sorts once (range
  partitioning, so every task holds a contiguous slice), stamps each row with
  ``monotonically_increasing_id`` (partition index in the high bits, position
  in the low 33 bits), writes the stamped rows to the shared folder so that the
  stamps are fixed, and adds the row count of all earlier partitions. Only one
  row per partition reaches the driver.
* ``prefix_offsets`` is a running sum in two levels: over the totals of the sorted
  partitions, and inside each partition.
* ``with_dense_ids`` turns (group, position-in-group) into global ids from
  per-group counts - no sort of the rows themselves.
* ``keys_at`` finds the keys at given ranks, for splits by position.
* ``join_per_group`` attaches a one-row-per-group table: broadcast under a
  measured size, a salted join beyond it, so a hot group is never one task.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis import session
from precis.session import measured_bytes, written

_LOW_BITS = 33
GROUP_SALTS = 16


def _stamped(df: DataFrame, order_cols) -> DataFrame:
    """Rows with ``_pid`` and ``_pos`` (partition and place of the sorted order),
    written once so that both are fixed."""
    # The range-partitioned sort samples its input and then reads it again:
    # keep the input cached while the sorted, stamped rows are written out.
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mono = F.col("_mono")
        rows = src.orderBy(*order_cols).withColumn("_mono", F.monotonically_increasing_id())
        rows = rows.withColumn("_pid", F.shiftright(mono, _LOW_BITS))
        return written(rows.withColumn("_pos", mono - F.shiftleft("_pid", _LOW_BITS)).drop("_mono"), "ranked")
    finally:
        src.unpersist()


def _before(rows: DataFrame, total: Column) -> list[tuple[int, int]]:
    """(partition, ``total`` of the partitions ahead of it): one row per partition
    of the sorted rows reaches the driver."""
    out, running = [], 0
    for row in rows.groupBy("_pid").agg(total.alias("_total")).orderBy("_pid").collect():
        out.append((int(row["_pid"]), running))
        running += int(row["_total"] or 0)
    return out


def _attach(rows: DataFrame, before: list[tuple[int, int]]) -> DataFrame:
    offsets = rows.sparkSession.createDataFrame(before or [(0, 0)], "_pid long, _off long")
    return rows.join(F.broadcast(offsets), "_pid")


def global_index(df: DataFrame, order_cols, name: str = "idx") -> DataFrame:
    """Add ``name``: 0-based rank of each row in ``order_cols`` (must be unique)."""
    rows = _stamped(df, order_cols)
    ranked = _attach(rows, _before(rows, F.count(F.lit(1))))
    return ranked.select(*df.columns, (F.col("_off") + F.col("_pos")).alias(name))


def keys_at(df: DataFrame, key: str, ranks: list[int]) -> list:
    """The key at each 0-based rank of ``key`` (unique, no nulls); None beyond the last row.

    Whole-number keys are found by histograms of their leading bits, with nothing sorted
    or written: each round counts the prefixes of the range that holds a rank and goes on
    in the prefix where the rank falls, ``BIN_BITS`` bits a round. Other keys are sorted,
    and only the wanted ones reach the driver."""
    if df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return _keys_by_histogram(df.select(F.col(key).cast("long").alias("_v")), ranks)
    return _keys_by_sort(df, key, ranks)


#: Bits of a key that a round settles: at most 2**12 counts for each wanted rank.
BIN_BITS = 12


def _keys_by_histogram(keys: DataFrame, ranks: list[int]) -> list:
    least, most, n = keys.agg(F.min("_v"), F.max("_v"), F.count("_v")).first()
    # rank -> (least key, most key, keys below the least) of the range that holds it
    open_ = {rank: (least, most, 0) for rank in ranks if 0 <= rank < n}
    found: dict[int, int] = {}
    while open_:
        ranges = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        shifts = [max(0, (hi - lo).bit_length() - BIN_BITS) for lo, hi in ranges]
        prefix = which = F.lit(None).cast("long")
        for k, ((lo, hi), shift) in enumerate(zip(ranges, shifts)):
            inside = F.col("_v").between(lo, hi)  # ranges of one round are equal or apart
            prefix = F.when(inside, F.shiftright("_v", shift)).otherwise(prefix)
            which = F.when(inside, F.lit(k).cast("long")).otherwise(which)
        binned = keys.select(which.alias("k"), prefix.alias("prefix")).where("k is not null").groupBy("k", "prefix").count()
        counts = {(r["k"], r["prefix"]): r["count"] for r in binned.collect()}  # some 2**BIN_BITS rows a range
        for rank, (lo, hi, below) in list(open_.items()):
            k = ranges.index((lo, hi))
            for _, at in sorted(c for c in counts if c[0] == k):
                if below + counts[k, at] > rank:
                    break
                below += counts[k, at]
            lo, hi = max(lo, at << shifts[k]), min(hi, ((at + 1) << shifts[k]) - 1)
            if lo == hi:
                found[rank] = lo
                del open_[rank]
            else:
                open_[rank] = (lo, hi, below)
    return [found.get(rank) for rank in ranks]


def _keys_by_sort(df: DataFrame, key: str, ranks: list[int]) -> list:
    rows = _stamped(df.select(key), [key])
    before = _before(rows, F.count(F.lit(1)))
    at = F.lit(False)
    wanted = {}
    for rank in ranks:
        inside = [(pid, off) for pid, off in before if off <= rank]
        if rank >= 0 and inside:
            pid, off = inside[-1]
            wanted[rank] = (pid, rank - off)
            at = at | ((F.col("_pid") == pid) & (F.col("_pos") == rank - off))
    found = {(r["_pid"], r["_pos"]): r[key] for r in rows.where(at).collect()}  # one row per rank
    return [found.get(wanted.get(rank)) for rank in ranks]


def prefix_offsets(df: DataFrame, order_col: str, count_col: str, name: str = "offset") -> DataFrame:
    """Exclusive running sum of ``count_col`` in ``order_col`` order (unique).

    Two levels, so no window covers all rows: rows are sorted into range
    partitions, the partitions' totals are summed up on the driver, and the
    running sum inside a partition is a window over that partition."""
    rows = _stamped(df, [order_col])
    rows = _attach(rows, _before(rows, F.sum(count_col)))
    inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("_off") + F.coalesce(F.sum(count_col).over(inside), F.lit(0))
    return rows.select(*df.columns, offset.alias(name))


def with_dense_ids(df: DataFrame, name: str = "id", file_col: str = "file", line_col: str = "line",
                   counts: DataFrame | None = None) -> DataFrame:
    """Dense 0-based ids over all groups (files, documents) in key order from
    (group, position-in-group) columns; the rows themselves are never sorted.

    ``counts`` (group, ``count``) saves counting the rows where the sizes of the
    groups are known before they are taken apart."""
    counts = df.groupBy(file_col).count() if counts is None else counts
    offsets = prefix_offsets(counts, file_col, "count", "_off").select(file_col, "_off")
    joined = join_per_group(df, offsets, file_col, salt_from=[F.col(line_col)])
    return joined.withColumn(name, F.col("_off") + F.col(line_col)).drop("_off")


def join_per_group(rows: DataFrame, per_group: DataFrame, keys, salt_from: list[Column], how: str = "inner",
                   salts: int = GROUP_SALTS, in_order: list[str] | None = None) -> DataFrame:
    """Join a table with one row per group (offsets, first positions, minima)
    onto rows of which one group may hold a large share.

    The per-group table is evaluated once. Under ``BROADCAST_BYTES`` (measured) it
    is broadcast. Beyond it the join is salted: every row gets a salt from
    ``salt_from`` columns and the per-group table is replicated once per salt
    (``explode``, no cross join), so a hot group is spread over ``salts`` join
    partitions. A broadcast leaves rows in the order in which they are read;
    ``in_order`` names the columns by which a salted join puts them back, groups whole."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    per_group = written(per_group, "per-group")
    if measured_bytes(per_group) <= session.BROADCAST_BYTES:
        return rows.join(F.broadcast(per_group), keys, how)
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)))
    seq = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    salted_groups = per_group.select("*", F.explode(seq).alias("_salt"))
    joined = salted_rows.join(salted_groups, keys + ["_salt"], how).drop("_salt")
    return joined.repartition(*keys).sortWithinPartitions(*in_order) if in_order else joined
