"""Session settings, and written tables in the shared folder where lineage is cut."""

import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# What a cluster job should set; spark.checkpoint.dir must then name a shared folder.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
SHARES = 8  # tasks that a split is dealt over where there are few
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BYTES = 8 << 20  # of whole texts that a Python function gets at once, or one longer row
_SCOPES: list[str] = []
_PROMISED: set[str] = set()
_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(master: str | None = None, app: str = "linkloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED[context.applicationId] = folder = tempfile.TemporaryDirectory(prefix="linkloom-")
    root = pathlib.Path(__file__).parent
    archive = pathlib.Path(folder.name) / "linkloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))  # the driver serves it to the executors


def shared_folder(spark: SparkSession) -> str:
    """This run's folder below the one named in spark.checkpoint.dir; it goes when the driver ends.

    Where Spark runs in one process and none is named, it is below the system's temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.gettempdir()
    run = f"{folder.rstrip('/')}/linkloom-{spark.sparkContext.applicationId}"
    if run not in _PROMISED:
        _PROMISED.add(run)
        path, files = _files(spark, run)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return run


def _files(spark: SparkSession, folder: str):
    """A path and its file system, whatever store it is in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, folder: str) -> None:
    path, files = _files(spark, folder)
    files.delete(path, True)


def new_scope(spark: SparkSession) -> str:
    """A folder for tables that are deleted together."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@contextmanager
def staging_below(folder: str) -> Iterator[str]:
    """Tables staged meanwhile are written below ``folder``; who made it deletes it."""
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables staged meanwhile are deleted at the end: results have to be written by then."""
    with staging_below(new_scope(spark)) as folder:
        try:
            yield folder
        finally:
            delete_folder(spark, folder)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python functions that run meanwhile get at most so many rows and TEXT_BYTES at once: for rows with
    whole texts. A batch is held several times over, in the JVM as well as in Python, by every task.
    """
    before = smaller_batches(spark, rows)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def smaller_batches(spark: SparkSession, rows: int) -> dict[str, str]:
    """Set the limits of ``arrow_batches`` for the session; returns those before."""
    before = {name: spark.conf.get(name) for name in (BATCH_ROWS, BATCH_BYTES)}
    now = int(before[BATCH_ROWS])
    spark.conf.set(BATCH_ROWS, str(min(rows, now) if now > 0 else rows))
    spark.conf.set(BATCH_BYTES, str(TEXT_BYTES))
    return before


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet and return the written table.

    For results that are read twice or carry values that must not change between two reads
    (row positions). The table is in shared storage, so lost executors cost nothing but a re-read.
    """
    spark = df.sparkSession
    path = path or f"{_SCOPES[-1] if _SCOPES else shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, **numbers: Column) -> tuple[Observation, DataFrame]:
    """The table, and what is known of it once it was written: ``rows`` and the aggregates ``numbers``.

    They are taken at the end of the plan, in the tasks that write, each of which counts once however
    often it is tried.
    """
    told = Observation()
    return told, df.observe(told, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in numbers.items()])


def stage_counted(df: DataFrame, **numbers: Column) -> tuple[DataFrame, dict]:
    """``stage``, with ``rows`` and the aggregates ``numbers`` of what was written."""
    told, watched = counted(df, **numbers)
    return stage(watched), told.get


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute rows that arrive in a few large splits over all cores, by unique-ish keys.

    Extraction costs far more than reading, and a compressed row grows to many times its size before
    it is grouped: a split becomes SHARES tasks, so that none has to sort more than fits its memory. An
    input of many splits, as any large one, is left alone; nothing is shuffled then.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= 4 * cores:
        return df
    return df.repartition(max(cores, SHARES * splits), *keys)
