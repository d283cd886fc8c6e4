"""Consecutive numbers over a total order, without sorting in one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in these bits


def with_dense_ids(
    df: DataFrame, order: list[Column | str], name: str, start: Column | int = 1, left_out: Sequence[str] = ()
) -> DataFrame:
    """Add ``name``: start, start+1, … in the order of the given columns; those ``left_out`` go.

    The rows are range-partitioned and sorted, and written once with their place in their
    partition. Only one count per partition is summed up, so the window over them and the
    broadcast are bounded by the number of shuffle partitions.
    """
    spot = F.monotonically_increasing_id()
    ranged = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop(*left_out)
        .withColumn("spot", spot)
        .withColumn("range_no", F.shiftright("spot", _ROW_BITS))
    )
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("range_no")
        .count()
        .select("range_no", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("range_start"))
    )
    place = F.col("spot") - F.shiftleft(F.col("range_no"), _ROW_BITS)
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        ranged.join(F.broadcast(offsets), "range_no")
        .withColumn(name, (F.col("range_start") + place + first).cast("long"))
        .drop("spot", "range_no", "range_start")
    )
