"""File scans: stories, JSON-lines records, delimited records, line files,
file pairing by sorted name, generation logs.

Line positions: a text scan keeps file order inside every split, so the
position of a row is (rows in earlier splits of the same file) + (its offset
inside its split). ``with_file_positions`` gets both without moving rows: it
stamps rows with ``monotonically_increasing_id``, counts rows per split (one
pre-scan, one small row per split), turns the counts into per-file offsets and
joins them back (broadcast below a measured size).

Files are known by one name throughout, the path as the scan's metadata writes
it, so that blanks and letters beyond ASCII in a path can't tell two spellings of
it apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from precis.operators.align import align, alignment_counts, check_aligned, ordinals, pair_by_rank
from precis.operators.ids import global_index, join_per_group, prefix_offsets, with_dense_ids
from precis.session import spread, written
from precis.sources.records import read_multiline

NEWS_SCHEMA = "text string, title string"

# Characters besides \n at which str.splitlines() also breaks a line.
EXTRA_LINE_BREAKS = r"\r|\x0b|\x0c|\x1c|\x1d|\x1e|\x85|\x{2028}|\x{2029}"


def with_file_positions(df: DataFrame, name: str = "line") -> DataFrame:
    """Add ``file`` and ``name`` (0-based row position within its file) to a
    DataFrame that comes straight from a line-oriented file scan."""
    stamped = df.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mono"),
    )
    blocks = stamped.groupBy("file", "_block").agg(F.min("_mono").alias("_base"), F.count("*").alias("_n"))
    w = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "_block", "_base", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    joined = join_per_group(stamped, offsets, ["file", "_block"], salt_from=[F.col("_mono")])
    return joined.withColumn(name, F.col("_off") + F.col("_mono") - F.col("_base")).drop("_block", "_mono", "_base", "_off")


def read_lines(spark: SparkSession, paths, line_sep: str = "\n", skip_lines: int = 0,
               split_all_breaks: bool = False) -> DataFrame:
    """(file, line, value) for every line of every file; ``skip_lines`` header
    lines per file are dropped. ``split_all_breaks`` further splits each line
    at every break ``str.splitlines`` knows (sub-lines keep the order)."""
    raw = spark.read.option("lineSep", line_sep).text(paths)
    df = with_file_positions(raw).where(F.col("line") >= skip_lines)
    if not split_all_breaks:
        return df.select("file", "line", "value")
    pieces = F.split(F.col("value"), EXTRA_LINE_BREAKS, -1)
    trailing = F.col("value").rlike("(" + EXTRA_LINE_BREAKS + r")\z")
    pieces = F.when(trailing, F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return df.select("file", "line", F.posexplode(pieces).alias("sub", "value")).select(
        "file", "line", "sub", "value"
    )


def count_lines(spark: SparkSession, path: str) -> int:
    """Number of ``\\n``-terminated lines (an unterminated last line counts)."""
    return spark.read.option("lineSep", "\n").text(path).count()


def read_delimited(spark: SparkSession, paths, delimiter: str = "\n") -> DataFrame:
    """(file, line, value): records split on ``delimiter``; one trailing empty
    record (a final delimiter) is not a record. Files are read as text-mode
    files are: ``\\r\\n`` and ``\\r`` count as ``\\n``."""
    if delimiter == "\n":  # the text source's default splits on \n, \r\n and \r
        raw = spark.read.text(paths)
        return with_file_positions(raw).select("file", "line", "value")
    if "\n" not in delimiter:
        raw = spark.read.option("lineSep", delimiter).text(paths)
        return with_file_positions(raw).select(
            "file", "line", F.regexp_replace("value", r"\r\n|\r", "\n").alias("value"))
    return read_multiline(spark, paths, delimiter)


def read_stories(spark: SparkSession, dirs) -> DataFrame:
    """(id, path, content): one row per story file of the given directories
    (not recursive). ids are dense ranks of the path."""
    if isinstance(dirs, str):
        dirs = [dirs]
    raw = spark.read.text(list(dirs), wholetext=True)
    files = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    ranks = global_index(files.select("path"), ["path"], "id")
    joined = join_per_group(files, ranks, "path", salt_from=[F.col("path")])
    return spread(joined.select("id", "path", "content"), "id", scan=raw)


def _listing(spark: SparkSession, paths) -> DataFrame:
    """(path): one row per file, as the scan's metadata writes it. Files without
    a byte are listed too, though a scan passes them over; the list is the one that
    Spark's file index holds on the driver for every scan."""
    files = spark.read.format("binaryFile").load(paths).inputFiles()
    # the listing writes file:///x where the metadata writes file:/x
    return spark.createDataFrame([(re.sub("^([^:/]+):///", r"\1:/", f),) for f in sorted(files)], "path string")


def read_documents(spark: SparkSession, paths) -> DataFrame:
    """(path, text): every file read whole as one document."""
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_records(spark: SparkSession, paths) -> DataFrame:
    """(id, text, title) from JSON lines (plain or compressed). Malformed JSON
    fails the job; a record without ``text`` or ``title`` fails it as well.
    ``id`` is the record's line position, counted across files in path order."""
    raw = spark.read.schema(NEWS_SCHEMA).option("mode", "FAILFAST").json(paths)
    pos = with_file_positions(raw)
    checked = pos.select(
        "file", "line",
        F.when(F.col("text").isNull(), F.raise_error(F.lit("record without 'text'"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("title").isNull(), F.raise_error(F.lit("record without 'title'"))).otherwise(F.col("title")).alias("title"),
    )
    # a gzip file is one task: spread the parsed records before the heavy work
    return spread(with_dense_ids(checked).select("id", "text", "title"), "id", scan=raw)


def pair_files(spark: SparkSession, target_pattern: str, prediction_pattern: str) -> DataFrame:
    """(rank, target_file, prediction_file) paired by sorted name; counts must
    be equal and at least one."""
    t = _listing(spark, target_pattern).select(F.col("path").alias("target_file"))
    p = _listing(spark, prediction_pattern).select(F.col("path").alias("prediction_file"))
    n_t, n_p = t.count(), p.count()
    if not n_t or n_t != n_p:
        raise ValueError(f"files can't be paired: {n_t} with targets, {n_p} with predictions")
    return pair_by_rank(t, p, "target_file", "prediction_file")


def read_aligned_records(spark: SparkSession, left_pattern: str, right_pattern: str, delimiter: str,
                         names: tuple[str, str]) -> DataFrame:
    """(id, left record, right record), the columns called ``names``: records of two sets
    of files aligned by (file rank, place in the file).

    Counts are compared per pair of files first: an uneven pair raises
    ``ValueError`` naming it, so no record is without a partner. ``id`` is 0-based
    over all files in rank order: the records of earlier files plus the place
    in the file, from a table with a row per file (no sort of the records)."""
    pairs = written(pair_files(spark, left_pattern, right_pattern), "file-pairs")
    sides = []
    for pattern, path, name in ((left_pattern, "target_file", names[0]), (right_pattern, "prediction_file", names[1])):
        records = read_delimited(spark, pattern, delimiter).withColumnRenamed("file", path)
        ranks = pairs.select("rank", path)
        ranked = join_per_group(records, ranks, path, salt_from=[F.col("line")], how="left")
        listed = F.when(F.col("rank").isNull(), F.raise_error(F.concat(F.lit("file not listed: "), path)))
        sides.append(ranked.select(F.coalesce(listed, F.col("rank")).cast("long").alias("rank"), "line",
                                   F.col("value").alias(name)))
    counts = alignment_counts(sides[0], sides[1], "rank", ("targets", "predictions"))
    # files without any record have no row on either side: they add nothing
    counts = written(counts.join(pairs, "rank"), "record-counts")
    check_aligned(counts.withColumn("files", F.concat_ws(" / ", "target_file", "prediction_file")), "files",
                  ("targets", "predictions"), "uneven files")
    offsets = prefix_offsets(counts.select("rank", "targets"), "rank", "targets", "offset").select("rank", "offset")
    left = join_per_group(sides[0], offsets, "rank", salt_from=[F.col("line")])
    both = align(left, sides[1], ["rank", "line"])
    return both.select((F.col("offset") + F.col("line")).alias("id"), *names)


def read_scoring_pairs(spark: SparkSession, target_pattern: str, prediction_pattern: str,
                       delimiter: str = "\n") -> DataFrame:
    """(id, target, prediction) aligned by (file rank, record position)."""
    return read_aligned_records(spark, target_pattern, prediction_pattern, delimiter, ("target", "prediction"))


def parse_generation_log(lines: DataFrame, value_col: str = "value", order_col: str | None = None) -> DataFrame:
    """(key, target, hypothesis) from ``T-<k>\\t<target>`` and
    ``H-<k>\\t<score>\\t<hypothesis>`` lines; word pieces are joined.

    A key that occurs several times pairs its n-th target with its n-th hypothesis, by ``order_col``
    (unique line places; without it, the order of the scan); unequal numbers raise ``ValueError``. A
    key of one side only is left out."""
    from precis.functions.text import join_wordpieces

    v = F.col(value_col)
    fields = F.split(v, "\t", -1)
    skip = F.when(v.startswith("T"), 1).when(v.startswith("H"), 2)
    body = F.array_join(F.slice(fields, skip + 1, F.greatest(F.size(fields) - skip, F.lit(1))), "\t")
    parsed = lines.where(v.startswith("T") | v.startswith("H")).select(
        F.substring(fields[0], 2, 1 << 20).alias("key"), v.startswith("T").alias("is_target"),
        join_wordpieces(body).alias("text"), *([F.col(order_col).alias("_place")] if order_col else []))
    if not order_col:
        parsed = parsed.withColumn("_place", F.monotonically_increasing_id())
    parsed = written(parsed, "generation-log")  # both sides of the join read it, and places are fixed
    # lines of one key pair off in their order, so a repeated key is no product of both sides
    places = written(ordinals(parsed, ["key", "is_target"], "_place"), "log-places")
    counts = alignment_counts(places.where("is_target"), places.where("not is_target"), "key",
                              ("targets", "hypotheses"))
    check_aligned(counts.where("targets > 0 and hypotheses > 0"), "key", ("targets", "hypotheses"), "generation log, key")
    parsed = align(parsed, places, ["key", "is_target", "_place"])
    t = parsed.where("is_target").select("key", "k", F.col("text").alias("target"))
    h = parsed.where("not is_target").select("key", "k", F.col("text").alias("hypothesis"))
    return align(t, h, ["key", "k"]).drop("k")
