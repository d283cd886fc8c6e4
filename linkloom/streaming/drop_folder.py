"""Importing files as they arrive in a folder."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions import fixed
from linkloom.plans.importer import Importer
from linkloom.sources.files import FILES_SCHEMA, literal_paths

# What one micro-batch lists at most; its paths come to the driver.
MAX_FILES_PER_BATCH = 1000


def arriving_files(importer: Importer, inbox: str, max_files: int = MAX_FILES_PER_BATCH) -> DataFrame:
    """The stream of text and CSV files put into the inbox; contents are not read here."""
    path = F.lower("path")
    wanted = path.endswith(fixed.IMPORT_SUFFIXES[0]) | path.endswith(fixed.IMPORT_SUFFIXES[1])
    return (
        importer.spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", "true")
        .load(inbox)
        .where(wanted)
        .select("path", "modificationTime", "length")
    )


def watch(
    importer: Importer,
    inbox: str,
    checkpoint: str,
    clock: Callable[[int], Column],
    name: str = "drop-folder",
    max_files: int = MAX_FILES_PER_BATCH,
) -> StreamingQuery:
    """Import what lies in the inbox, one import per micro-batch, then stop.

    The commit of an import carries the batch number, so a batch that Spark repeats after a failure
    is not imported twice. ``clock`` gives the import time of a batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if importer.library.batch_done(name, batch_id):
            return
        rows = batch.collect()  # at most max_files
        if not rows:
            return
        paths = [r.path for r in rows]
        files = importer.spark.createDataFrame(
            [(r.path, r.path.rsplit("/", 1)[-1], r.length, r.modificationTime) for r in rows],
            FILES_SCHEMA,
        )
        importer.import_files(files, literal_paths(paths), clock(batch_id), name, batch_id)

    return (
        arriving_files(importer, inbox, max_files)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
