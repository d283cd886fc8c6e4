"""Arrow batches cut into slices of bounded text, and the table columns the operators read."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
_KEPT: dict[str, dict[tuple, object]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name the table does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"{stem}_{uuid.uuid4().hex[:8]}"
    return name


def kept(kind: str, key: tuple, make: Callable[[], object], alone: bool = False) -> object:
    """What a Python worker keeps from task to task, made once. One kind at a time: workers outlive their stage.

    Of a kind that is kept ``alone`` it is the last one only.
    """
    if kind not in _KEPT or (alone and key not in _KEPT[kind]):
        _KEPT.clear()
    own = _KEPT.setdefault(kind, {})
    if key not in own:
        own[key] = make()
    return own[key]


def forget() -> None:
    """Drop what stages before have left in this worker."""
    _KEPT.clear()


def release() -> None:
    """Give what is free in this worker back to the system: an executor has more workers than run at once."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``most`` bytes in ``column``, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for row, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += max(size, 1)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, … of every run, one run after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)
