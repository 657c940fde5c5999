"""Sinks: aligned text export, pair/split tables, CSV score reports.

All writers refuse to overwrite (``errorifexists``). Text export of a pair
table writes ``<dir>/<tag>.articles`` and ``<dir>/<tag>.summaries``, all splits
in one job: a task writes both sides of its id range, so part file k of both
folders holds the same ids in the same order for any partition count. The job
writes to a hidden folder beside its targets; what it wrote gets its names
when all of it is there (``commit_together``), so a failed job leaves nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.constants import ARTICLES_TAG, SUMMARIES_TAG

#: Beginning of the hidden folders in which outputs wait for their names; the list of these.
STAGED, MANIFEST = "_staged-", "_targets.json"


def _path_exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def commit_together(spark, staged: str, targets: list[tuple[str, str]]) -> None:
    """Give the folders ``(name below staged, final path)`` their final paths, all of them or none.

    The list is written into ``staged`` first: it is the commit. A writer that dies after it
    is completed by ``complete_commits``; an error while names are given takes them back."""
    path, files = _files(spark, staged)
    for name, _ in targets:  # a side without rows is an empty folder, and every folder is marked complete
        files.mkdirs(path(f"{staged}/{name}"))
        files.create(path(f"{staged}/{name}/_SUCCESS"), True).close()
    out = files.create(path(f"{staged}/{MANIFEST}.growing"), True)
    try:
        out.write(bytearray(json.dumps(targets).encode()))
    finally:
        out.close()
    if not files.rename(path(f"{staged}/{MANIFEST}.growing"), path(f"{staged}/{MANIFEST}")):
        raise RuntimeError(f"no list of targets in {staged}")
    given = []
    try:
        for name, target in targets:
            _give_name(files, path, f"{staged}/{name}", target)
            given.append((name, target))
    except Exception:
        files.delete(path(f"{staged}/{MANIFEST}"), False)
        for name, target in given:
            files.rename(path(target), path(f"{staged}/{name}"))
        raise
    files.delete(path(staged), True)


def _give_name(files, path, source: str, target: str) -> None:
    if files.exists(path(target)) or not files.rename(path(source), path(target)):
        raise RuntimeError(f"{source} could not get the name {target}")


def complete_commits(spark, target_dir: str) -> None:
    """Finish the commits below ``target_dir`` whose writer died while it gave names."""
    path, files = _files(spark, target_dir)
    if not files.exists(path(target_dir)):
        return
    for status in files.listStatus(path(target_dir)):
        staged = status.getPath().toString()
        if not status.getPath().getName().startswith(STAGED) or not files.exists(path(f"{staged}/{MANIFEST}")):
            continue
        stream = files.open(path(f"{staged}/{MANIFEST}"))
        try:
            targets = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        for name, target in targets:
            if files.exists(path(f"{staged}/{name}")):
                _give_name(files, path, f"{staged}/{name}", target)
        files.delete(path(staged), True)


def _files(spark, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_aligned(pairs: DataFrame, target_dir: str, tags: list[str], tag: Column, partitions: int | None) -> list[tuple[str, str]]:
    """Articles and summaries of every tag by one job and one commit."""
    spark, base = pairs.sparkSession, target_dir.rstrip("/")
    path, files = _files(spark, base)
    paths = [(f"{base}/{t}.{ARTICLES_TAG}", f"{base}/{t}.{SUMMARIES_TAG}") for t in tags]
    complete_commits(spark, base)
    for one in [p for both in paths for p in both]:
        if _path_exists(spark, one):
            raise RuntimeError(f"refusing to write over {one}")
    one_line = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\r\n|\r|\n", " ")
    rows = pairs.select("id", tag.alias("_tag"), one_line("article").alias("article"), one_line("summary").alias("summary"))
    # without a number of parts, adaptive execution joins ranges to parts of its advisory size
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), "_tag", "id")
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("value")) for i, c in enumerate(("article", "summary"))])
    # one number of a folder for tag and side: the sort below begins with the column the writer divides rows by, so that it
    # sorts no second time and the order of ids stays
    lines = ranged.select("_tag", "id", F.explode(sides).alias("line")).select(
        (2 * F.col("_tag") + F.col("line.side")).alias("_folder"), "id", F.col("line.value").alias("value"))
    staged = f"{base}/{STAGED}{uuid.uuid4().hex}"
    try:
        lines.sortWithinPartitions("_folder", "id").select("_folder", "value").write.partitionBy("_folder").text(staged)
        commit_together(spark, staged, [(f"_folder={i}", one) for i, one in enumerate(p for both in paths for p in both)])
    except Exception:
        files.delete(path(staged), True)
        raise
    return paths


def write_pairs_text(pairs: DataFrame, target_dir: str, tag: str, partitions: int | None = None) -> tuple[str, str]:
    """``<target_dir>/<tag>.articles`` and ``.summaries``, aligned line by line, both or none. Null texts are empty
    lines, line breaks inside a text become blanks; no pairs give two empty folders."""
    return _write_aligned(pairs, target_dir, [tag], F.lit(0), partitions)[0]


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """``<path>/split=train|val|test/`` parquet; readers prune by split."""
    write_table(df, path, "split")


def write_split_text(pairs: DataFrame, target_dir: str, splits=("train", "val", "test")) -> list[tuple[str, str]]:
    """``<target_dir>/{train,val,test}.articles`` and ``.summaries``, aligned line by line; all of them or none,
    from one pass over the pairs. Rows of other splits are left out."""
    number = F.coalesce(*[F.when(F.col("split") == name, F.lit(i)) for i, name in enumerate(splits)])
    return _write_aligned(pairs.where(F.col("split").isin(*splits)), target_dir, list(splits), number, None)


def write_sample(df: DataFrame, target_dir: str) -> None:
    if not target_dir:
        raise ValueError("a folder for the sample is needed")
    if _path_exists(df.sparkSession, target_dir):
        raise ValueError(f"{target_dir!r} is there already")
    write_table(df, target_dir)


def format_aggregate_csv(report_rows) -> str:
    """``score_type,low,mid,high`` then rows in type order, R, P, F; ``%f``."""
    lines = ["score_type,low,mid,high"]
    for r in sorted(report_rows, key=lambda r: (r["_type"], r["_ord"])):
        lines.append("%s,%f,%f,%f" % (r["score_type"], r["low"], r["mid"], r["high"]))
    return "\n".join(lines) + "\n"


def write_aggregate_csv(report: DataFrame, path: str) -> str:
    """The report has at most 3 rows per score type: it is formatted on the
    driver (Python ``%f``) and written as one text file."""
    text = format_aggregate_csv(report.collect())
    spark = report.sparkSession
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return text


def write_example_csv(wide: DataFrame, path: str) -> None:
    """Per-example CSV (``id,{t}-P,{t}-R,{t}-F,...``) ordered by id; values formatted like Python ``%f``. The part
    files, one after the other, are the CSV: the header is the first line of the first part alone, whatever
    the number of parts (``join_parts`` makes one file of them)."""
    from precis.sources.formatting import format_f

    if not wide.limit(1).collect():  # no scores: nothing is written
        return
    cells = [F.col("id").cast("string")] + [F.coalesce(format_f(F.col(f"`{c}`")), F.lit("")) for c in wide.columns if c != "id"]
    body = wide.select(F.lit(1).alias("_ord"), F.col("id").alias("_id"), F.concat_ws(",", *cells).alias("value"))
    names = ",".join(["id", *[c for c in wide.columns if c != "id"]])
    head = wide.sparkSession.range(1).select(
        F.lit(0).alias("_ord"), F.lit(None).cast(wide.schema["id"].dataType).alias("_id"), F.lit(names).alias("value"))
    out = head.unionByName(body).repartitionByRange("_ord", "_id").sortWithinPartitions("_ord", "_id")
    out.select("value").write.mode("errorifexists").text(path)


def join_parts(spark, folder: str, target: str) -> None:
    """The part files of ``folder``, in order, as the one file ``target``: bytes are copied from file to file, no row
    is read. The file gets its name when it is whole; an existing one is refused."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(conf)
    names = sorted(s.getPath().toString() for s in files.listStatus(path(folder)) if s.getPath().getName().startswith("part-"))
    if _path_exists(spark, target):
        raise RuntimeError(f"refusing to write over {target}")
    out_files = path(target).getFileSystem(conf)
    growing = path(f"{target}.growing")
    out = out_files.create(growing, True)
    try:
        for name in names:
            part = files.open(path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    if not out_files.rename(growing, path(target)):
        raise RuntimeError(f"{growing} could not be given its name")


def write_lines(df: DataFrame, path: str, order_col="line", value_col: str = "value") -> None:
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(value_col).write.mode("errorifexists").text(path)
