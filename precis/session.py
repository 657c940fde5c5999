"""Session helpers.

``get_session`` builds a local session for tests and benchmarks;
``submitted_session`` takes the one spark-submit configures. ``ensure_checkpoint_dir``
reads ``spark.checkpoint.dir`` from the session and only picks a scratch folder
for a local master; off ``local`` it refuses to guess.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table (offsets, lexicon, file list) is broadcast only if its measured size
# is below this many bytes; larger ones take the shuffle join.
BROADCAST_BYTES = 64 * 1024 * 1024


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "precis") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # long texts: keep Arrow batches to the Python workers moderate
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.driver.memory", os.environ.get("PRECIS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
        # checkpoints go when the frames that read them are garbage
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def submitted_session(app: str = "precis") -> SparkSession:
    """The session as spark-submit configures it: master, memory and shuffle
    partitions are not touched."""
    spark = SparkSession.builder.appName(app).getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``precis`` importable in the executors' Python workers.

    Pandas UDFs and ``mapInPandas`` functions live in this package and are
    pickled by reference, so every worker must be able to import it. The
    package is zipped once per application and added with ``addPyFile``
    (the same as ``spark-submit --py-files``)."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import precis

    pkg_dir = os.path.dirname(os.path.abspath(precis.__file__))
    root = os.path.dirname(pkg_dir)
    path = os.path.join(tempfile.mkdtemp(prefix="precis-pyfiles-"), "precis.zip")
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="precis-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it
    back: the lineage is cut, a lost executor costs no recomputation of what came
    before, and later readers still prune columns. The table goes with the driver
    (or earlier, by ``discard``). Row order and partitions are not kept."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes with the driver."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target, files = _file_system(spark, path)
    files.deleteOnExit(target)
    return path


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path is not None:
        target, files = _file_system(df.sparkSession, path)
        files.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


#: Bytes of an Arrow batch handed to a Python worker (Spark's default is 64 MB, of which a worker
#: holds several copies); one row is never cut.
BATCH_BYTES = 8 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in this session, unless they are set in it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df``: text and binary columns by their length, others as 8."""
    size = F.lit(0)
    for field in df.schema.fields:
        plain = field.dataType.simpleString() in ("string", "binary")
        size = size + (F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)) + 16 if plain else F.lit(8))
    return int(df.agg(F.sum(size.cast("long"))).first()[0] or 0)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and return a frame
    that reads it back (lineage cut; survives executor loss).

    The frame is persisted while the checkpoint job runs so that the count
    and the checkpoint write share one evaluation of the plan."""
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


def spread(df: DataFrame, key: str | list[str] | None = None, min_partitions: int | None = None,
           scan: DataFrame | None = None) -> DataFrame:
    """Give CPU-heavy narrow stages enough tasks.

    A scan of a few large row groups or of non-splittable (gzip) files yields
    fewer partitions than cores, and every regex/UDF stage after it would run
    on those few tasks. Then the rows are hash-repartitioned on ``key``
    (deterministic on retry); a scan that already has enough splits - the
    normal case for large inputs - is left untouched (no shuffle).

    The split count is read from ``scan`` (the plain file scan ``df`` comes
    from) when given: asking a frame with shuffles for its partitions would
    make adaptive execution run those stages first."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if (scan if scan is not None else df).rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *([key] if isinstance(key, str) else key or []))
