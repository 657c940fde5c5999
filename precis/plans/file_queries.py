"""Registered queries of the file operators: a given table is written out as files into the shared
folder, read by the library's own readers, and the rows returned.

Files hold ``P.FILE_ROWS`` rows of neighbouring ids, each written by one task, so that their number
grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.operators.ids import with_dense_ids
from precis.plans import jobs
from precis.plans import params as P
from precis.plans.queries import conversation_pairs, table
from precis.session import shared_path
from precis.sources import files, sinks


def text_files(rows: DataFrame, place: str, value, name: str, line_sep: str = "\n", group=None) -> str:
    """The folder of text files ``file=<number>/part-*`` with ``value`` of ``rows`` in the order of ``place``."""
    path = shared_path(rows.sparkSession, name)
    number = F.floor(F.col(place) / P.FILE_ROWS).cast("long") if group is None else group
    out = rows.select(number.alias("file"), F.col(place).alias("_place"), value.alias("value"))
    out = out.repartition("file").sortWithinPartitions("file", "_place").select("file", "value")
    out.write.partitionBy("file").option("lineSep", line_sep).text(path)
    return path


def _number(path_col: str = "file"):
    return F.regexp_extract(path_col, r"/file=([0-9]+)/", 1).cast("long")


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def q_delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts between blank lines, every other file with ``\\r\\n``; texts hold blank lines of their own."""
    docs = _documents(spark, sf_dir)
    odd = F.floor(F.col("doc_id") / P.FILE_ROWS) % 2 == 1
    text = F.concat("text", F.lit("\n\n"))
    text = F.when(odd, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    # the sink ends every text with a line break itself: the last one of the delimiter
    path = text_files(docs.withColumn("value", text), "doc_id", F.expr("left(value, length(value) - 1)"), "delimited")
    out = files.read_delimited(spark, f"{path}/*", "\n\n")
    return out.select(_number().alias("file"), "line", "value")


def q_item_stories(spark, sf_dir):
    """One story file per benchmark item; ids are ranks of the paths."""
    items = table(spark, sf_dir, "benchmark")
    path = text_files(items, "item_id", F.col("text"), "stories", group=F.col("item_id"))
    return files.read_stories(spark, [f"{path}/*"]).select("id", _number("path").alias("item_id"), "content")


def q_item_documents(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    path = text_files(items, "item_id", F.col("text"), "documents", group=F.col("item_id"))
    return files.read_documents(spark, f"{path}/*").select(_number("path").alias("item_id"), "text")


def q_json_records(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    line = F.to_json(F.struct(F.col("html").alias("text"), F.col("url").alias("title")))
    path = text_files(pages, "page_id", line, "records")
    return files.read_records(spark, f"{path}/*").select("id", "title", "text")


def q_file_lines(spark, sf_dir):
    """Lines of files without their first, cut at every break that ``str.splitlines`` knows."""
    path = text_files(_documents(spark, sf_dir), "doc_id", F.replace("text", F.lit("e "), F.lit("e\x0b")), "lines")
    out = files.read_lines(spark, f"{path}/*", skip_lines=1, split_all_breaks=True)
    return out.select(_number().alias("file"), "line", F.col("sub").cast("long").alias("sub"), "value")


def q_line_count(spark, sf_dir):
    path = text_files(_documents(spark, sf_dir), "doc_id", F.col("text"), "lines")
    return spark.createDataFrame([(files.count_lines(spark, f"{path}/*"),)], "n_lines long")


def _marked_or_none(line, suffix):
    return line.replace("a", "A") + suffix if line else None


def q_line_job(spark, sf_dir):
    """A function over the lines of files, its results written in order and read back with their places."""
    path = text_files(_documents(spark, sf_dir), "doc_id", F.col("text"), "lines")
    out = shared_path(spark, "line-job")
    jobs.map_file_lines(spark, f"{path}/*", _marked_or_none, ("!",), out, skip_lines=1)
    return with_dense_ids(files.read_lines(spark, out)).select("id", "value")


def _aligned(spark, sf_dir) -> tuple[str, str]:
    pairs = conversation_pairs(spark, sf_dir).select("id", F.col("target").alias("article"), F.col("prediction").alias("summary"))
    folder = shared_path(spark, "pairs")
    return sinks.write_pairs_text(pairs, folder, "all")


def q_pairs_round_trip(spark, sf_dir):
    return jobs.read_aligned(spark, *_aligned(spark, sf_dir)).select("id", "article", "summary")


def q_split_round_trip(spark, sf_dir):
    target = shared_path(spark, "split")
    jobs.split_files(spark, *_aligned(spark, sf_dir), target, P.SPLIT_RATIO)
    return spark.read.parquet(target).select("id", "split", "article", "summary")


def q_split_text_round_trip(spark, sf_dir):
    """The test part as aligned text files, read back."""
    target = shared_path(spark, "split-text")
    jobs.split_files(spark, *_aligned(spark, sf_dir), target, P.SPLIT_RATIO, as_text=True)
    return jobs.read_aligned(spark, f"{target}/test.articles", f"{target}/test.summaries").select("id", "article", "summary")


def q_sample_round_trip(spark, sf_dir):
    target = shared_path(spark, "sample")
    share = jobs.sample_files(spark, *_aligned(spark, sf_dir), target, length=P.SAMPLE_BYTES)
    return spark.read.parquet(target).select("id", "article", "summary", F.lit(share).alias("share"))


def q_score_files(spark, sf_dir):
    """The scoring job from files to its CSV, read back."""
    out = shared_path(spark, "scores")
    jobs.score_files(spark, *_aligned(spark, sf_dir), out, ["rouge1", "rouge2"], n_samples=P.BOOT_SAMPLES,
                     confidence=P.BOOT_CONFIDENCE, seed=P.BOOT_SEED, method="poisson")
    return spark.read.option("header", "true").schema("score_type string, low double, mid double, high double").csv(out)


QUERIES = {
    "delimited_records": q_delimited_records,
    "item_stories": q_item_stories,
    "item_documents": q_item_documents,
    "json_records": q_json_records,
    "file_lines": q_file_lines,
    "line_count": q_line_count,
    "line_job": q_line_job,
    "pairs_round_trip": q_pairs_round_trip,
    "split_round_trip": q_split_round_trip,
    "split_text_round_trip": q_split_text_round_trip,
    "sample_round_trip": q_sample_round_trip,
    "score_files": q_score_files,
}
