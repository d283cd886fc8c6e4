"""Keeping long expression chains from being copied by the optimizer."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, kept: list[str], columns: list[Column]) -> DataFrame:
    """Select ``kept`` and ``columns`` so that ``columns`` are evaluated exactly once per row.

    A filter on a projected column is pushed below the projection, which copies the column's
    whole expression, and a chain of projections multiplies with every step. The output of a
    generator is opaque to that rule, and a generator over a one-element array stays in
    generated code. Filters on ``kept`` columns are still pushed to the scan.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*columns))))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
