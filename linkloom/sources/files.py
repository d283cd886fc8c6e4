"""Text and CSV files: discovery, fingerprints and line numbers."""

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import fixed
from linkloom.functions.unwrap import percent_decode
from linkloom.session import stage

# A line's digest is folded into so many lanes of 60 bits.
LANES = 4
FILES_SCHEMA = "path string, file_name string, file_size long, modified timestamp"


def file_path() -> Column:
    """Path of the file a row was read from; Spark's file metadata has it percent-encoded."""
    return percent_decode(F.col("_metadata.file_path"))


def literal_paths(paths: list[str]) -> list[str]:
    """Paths for a reader that would take ``*``, ``[`` and the like for patterns."""
    return [re.sub(r"([\\*?{}\[\],])", r"\\\1", p) for p in paths]


def path_order(path: str = "path") -> list[Column]:
    """Files sort by the parts of their path."""
    return [F.split(path, "/")]


def _suffix_is(path: Column, suffixes: tuple[str, ...]) -> Column:
    match = F.lit(False)
    for suffix in suffixes:
        match = match | F.lower(path).endswith(suffix)
    return match


def wanted_file(path: Column, target: str, recursive: bool) -> Column:
    """Text and CSV files below a folder, only direct ones unless recursive, or the target itself."""
    place = "/" + target.split(":", 1)[-1].strip("/")
    direct = F.lit(True) if recursive else ~F.substring_index(path, place + "/", -1).contains("/")
    return path.endswith(place) | (_suffix_is(path, fixed.IMPORT_SUFFIXES) & direct)


def _passed_over(spark: SparkSession, target: str, listed: int) -> list[tuple]:
    """FILES_SCHEMA rows of what Spark's readers do not list: empty files and hidden names.

    The store's own summary tells whether there are any; only then the names are gone through, one
    listing of the driver, as Spark's own is.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path) or store.getContentSummary(path).getFileCount() == listed:
        return []
    rows, found = [], store.listFiles(path, True)
    while found.hasNext():
        file = found.next()
        name = file.getPath().getName()
        if file.getLen() == 0 or name.startswith(("_", ".")):
            rows.append((file.getPath().toString(), name, file.getLen(), None))
    return rows


def discover_files(spark: SparkSession, target: str, recursive: bool = False) -> DataFrame:
    """path, file_name, file_size and modified of the files to import; nothing is opened.

    The whole tree is listed and filtered, as a plain listing would take folders named ``k=v`` for
    partitions. Empty files are listed as well. Files with hidden names (``_`` or ``.`` first), which
    no reader of Spark opens, are told by ``hidden_files``.
    """
    return _discovered(spark, target, recursive, hidden=False)


def hidden_files(spark: SparkSession, target: str, recursive: bool = False) -> DataFrame:
    """The same of files that cannot be read because of their names."""
    return _discovered(spark, target, recursive, hidden=True)


def _discovered(spark: SparkSession, target: str, recursive: bool, hidden: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        listed = reader.load(target).select(
            "path",
            F.substring_index("path", "/", -1).alias("file_name"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("modified"),
        )
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        listed = spark.createDataFrame([], FILES_SCHEMA)
    others = spark.createDataFrame(_passed_over(spark, target, listed.count()), FILES_SCHEMA)
    secret = F.col("file_name").startswith("_") | F.col("file_name").startswith(".")
    every = others.where(secret) if hidden else listed.unionByName(others.where(~secret))
    return every.where(wanted_file(F.col("path"), target, recursive))


def read_lines(spark: SparkSession, paths: list[str] | str, suffix_csv: bool | None = None) -> DataFrame:
    """Lines of text files with the place they were read at: path, block_start, spot, text.

    ``spot`` grows within a block, so the lines of a block are numbered by it once it is written
    down. Invalid bytes become replacement characters. ``suffix_csv`` keeps CSV files or all others;
    the test is on file metadata and prunes whole files.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(paths)
    path = file_path()
    if suffix_csv is not None:
        is_csv = F.lower(path).endswith(".csv")
        lines = lines.where(is_csv if suffix_csv else ~is_csv)
    return lines.select(
        path.alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("spot"),
        F.make_valid_utf8("value").alias("text"),
    )


def block_starts(staged: DataFrame) -> DataFrame:
    """First spot of every block and the number of lines before it in its file.

    The window runs over the blocks of a file, one row for each split of it.
    """
    before = (
        Window.partitionBy("path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        staged.groupBy("path", "block_start")
        .agg(F.min("spot").alias("first_spot"), F.count(F.lit(1)).alias("lines"))
        .withColumn("lines_before", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    )


def with_line_numbers(staged: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Add ``line_no``, from 1 within each file.

    The join is on file and block, so no key has more rows than a split has lines.
    """
    starts = block_starts(staged) if starts is None else starts
    return staged.join(
        starts.select("path", "block_start", "first_spot", "lines_before"), ["path", "block_start"]
    ).select(
        *staged.columns,
        (F.col("spot") - F.col("first_spot") + F.col("lines_before") + 1).alias("line_no"),
    )


def _folded(lanes: list[Column], lines: Column, size: Column) -> Column:
    return F.sha2(F.concat_ws("-", *lanes, lines, size), 256)


def empty_fingerprint() -> Column:
    """The hash of a file without bytes, which no reader hands out."""
    zero = F.lit("0")
    return _folded([zero] * LANES, zero, zero)


def fingerprints(
    spark: SparkSession, target: list[str] | str, wanted: Callable[[Column], Column] | None = None
) -> DataFrame:
    """path, file_size and file_hash of every file that has bytes; ``wanted`` tests its path.

    Files are cut at line feeds alone, so their lines and their size determine their bytes. Every
    line's SHA-256 is hashed again with its number and folded into LANES sums without order: one rule
    for files of any size, worked out split by split. Other files are pruned before a byte is read.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(target)
    if wanted is not None:
        lines = lines.where(wanted(file_path()))
    digests = lines.select(
        file_path().alias("path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("spot"),
        F.sha2("value", 256).alias("digest"),
    )
    numbered = with_line_numbers(stage(digests))
    placed = numbered.select(
        "path", "file_size", F.sha2(F.concat_ws(":", "line_no", "digest"), 256).alias("digest")
    )
    lanes = [
        F.bit_xor(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("long")).alias(f"lane_{i}")
        for i in range(LANES)
    ]
    folded = placed.groupBy("path", "file_size").agg(*lanes, F.count(F.lit(1)).alias("lines"))
    file_hash = _folded([F.col(f"lane_{i}") for i in range(LANES)], F.col("lines"), F.col("file_size"))
    return folded.select("path", "file_size", file_hash.alias("file_hash"))
