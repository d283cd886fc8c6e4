"""Bloom filters of URLs as tables: rows of 64-bit cells, built and asked with column expressions.

Every URL sets four bits in each of two cells. A filter has a power of two of cells, half as many as
URLs at least, so that a wrong answer comes once in some ten thousand times; a missing one never.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 2  # cells that a URL has
_SHIFTS = (40, 46, 52, 58)


def cells_for(urls: int) -> int:
    """Cells of a filter for so many URLs; 0 for none."""
    return 1 << max(urls // 2, 1).bit_length() if urls else 0


def _mask(value: Column) -> Column:
    mask = F.lit(0).cast("long")
    for shift in _SHIFTS:
        bit = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def _places(df: DataFrame, column: str, cells: Column) -> DataFrame:
    """word, cell and mask of every value, a row for each of its cells."""
    values = [F.struct(F.lit(n).alias("word"), F.xxhash64(F.col(column), F.lit(n)).alias("value")) for n in range(WORDS)]
    placed = df.withColumn("place", F.explode(F.array(*values)))
    value = F.col("place.value")
    return placed.select(
        *df.columns, F.col("place.word").alias("word"), value.bitwiseAND(cells.cast("long") - 1).alias("cell"), _mask(value).alias("mask")
    )


def filter_cells(df: DataFrame, column: str, cells: int) -> DataFrame:
    """The filled cells of a filter over a column: cells (their number), cell, bits."""
    placed = _places(df.select(column), column, F.lit(cells))
    filled = placed.groupBy("cell").agg(F.bit_or("mask").alias("bits"))
    return filled.select(F.lit(cells).cast("long").alias("cells"), "cell", "bits")


def probes(df: DataFrame, column: str, sizes: list[int]) -> DataFrame:
    """What to look up for every value in filters of these sizes: the column, cells, word, cell, mask."""
    sized = df.select(column, F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("cells"))
    return _places(sized, column, F.col("cells"))


def passed(filters: DataFrame, asked: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``keys`` of the filters and the values that each may hold; a value passes if all its cells do."""
    met = filters.join(asked, ["cells", "cell"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    found = met.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == WORDS).select(*keys, column)
