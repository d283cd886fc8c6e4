"""Trigrams of files of links, by which a search for a part of a text passes over most files.

A trigram is three bytes of UTF-8 with A-Z lowered. Every file of links leaves the distinct trigrams of
its URLs and source names. A file may hold a text with some part only if it has all trigrams of the
part; what such files hold is compared in full.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _codes(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data]
    return (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]


def pattern_codes(pattern: str) -> set[int]:
    """Trigrams of what a LIKE pattern says literally: between its wildcards ``%`` and ``_``."""
    found: set[int] = set()
    for run in re.split("[%_]", pattern):
        raw = np.frombuffer(run.encode(), dtype=np.uint8)
        if len(raw) > 2:
            found.update(_codes(raw).tolist())
    return found


def _mark(seen: np.ndarray, texts: pa.Array) -> None:
    """Mark the trigrams of every text; none reaches over two texts."""
    texts = texts.drop_null().cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    if len(raw) < 3:
        return
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    seen[_codes(raw)[owner[:-2] == owner[2:]]] = True


def file_trigrams(links: DataFrame, columns: tuple[str, ...] = ("normalized_url", "source_file")) -> DataFrame:
    """file and codes, the distinct trigrams of its rows, for tables read from files.

    A file that is read in several tasks gives a row for each of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, np.zeros(1 << 24, dtype=bool)

        def row() -> pa.RecordBatch:
            codes = np.flatnonzero(seen).astype(np.int32)
            seen[codes] = False
            return pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pa.array(codes))], ["file", "codes"]
            )

        for batch in batches:
            files = batch.column("file").dictionary_encode()
            numbers = files.indices.to_numpy(zero_copy_only=False)
            heads = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist()] if len(numbers) else []
            for head, end in zip(heads, [*heads[1:], len(numbers)]):
                name = files.dictionary[int(numbers[head])].as_py()
                if at is not None and name != at:
                    yield row()
                at = name
                for column in columns:
                    _mark(seen, batch.column(column).slice(head, end - head))
        if at is not None:
            yield row()

    return links.select(F.col("_metadata.file_name").alias("file"), *columns).mapInArrow(run, "file string, codes array<int>")


def holds(wanted: set[int]) -> Column:
    """Whether a row of ``file_trigrams`` has all of these."""
    codes = F.array(*[F.lit(c).cast("int") for c in sorted(wanted)])
    return F.size(F.array_except(codes, F.col("codes"))) == 0
