"""Best-fit packing of tokenised documents into sequences.

Best-fit decreasing over all pieces at once. Pieces of one length are interchangeable, so the placing
is worked out on the histogram of lengths, which has at most ``capacity`` rows however many documents
there are: for every length, longest first, a segment tree over remaining capacities finds the
tightest open sequences in logarithmic time, and as many pieces as fit go there in one step. The
result is exactly that of placing the pieces one after the other. It is a list of runs over the rank
of a piece in the order (length descending, doc_id, piece); the rows then look up their rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.batches import slices, whole_text
from linkloom.llm.encode import encoder
from linkloom.operators.numbering import with_dense_ids
from linkloom.session import stage

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities 0..most; a leaf holds the open sequences with it."""

    def __init__(self, most: int) -> None:
        self.width = 1 << most.bit_length()
        self.open = [0] * (2 * self.width)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, first: int, count: int) -> None:
        """Sequences first, first+1, … now have this capacity left."""
        if count:
            self.ranges[capacity].append((first, count))
            self._change(capacity, count)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Remove up to ``most`` consecutive sequences of this capacity."""
        first, count = self.ranges[capacity].pop()
        if count > most:
            self.ranges[capacity].append((first + most, count - most))
            count = most
        self._change(capacity, -count)
        return first, count

    def _change(self, leaf: int, by: int) -> None:
        node = leaf + self.width
        while node:
            self.open[node] += by
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """Smallest capacity >= length that an open sequence has: up from the leaf, then down."""
        node = length + self.width
        if self.open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (first rank, length, pieces per sequence, first sequence, offset) of the packing.

    ``histogram``: number of pieces by length, 1..capacity. Piece i of a run goes to sequence
    ``first + i // per`` at ``offset + (i % per) * length``.
    """
    tree, runs, rank, opened = CapacityTree(capacity), [], 0, 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                per = room // length
                count = -(-left // per)
                first, opened = opened, opened + count
            else:
                per = room // length
                first, count = tree.take(room, -(-left // per))
            placed = min(left, per * count)
            runs.append((rank, length, per, first, capacity - room))
            full, rest = divmod(placed, per)
            tree.add(room - per * length, first, full)
            if rest:
                tree.add(room - rest * length, first + full, 1)
            rank, left = rank + placed, left - placed
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document; longer documents are cut, others whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaced=False).encode
        for batch in batches:
            for part in slices(batch, "text"):
                found = encode(part.column("text").to_pylist())
                ends = np.cumsum(found["lengths"])
                flat = np.insert(found["ids"], ends, end_id).astype("<u4")
                lengths = found["lengths"] + 1
                pieces = -(-lengths // capacity)
                row = np.repeat(np.arange(len(lengths)), pieces)
                number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                size = np.minimum(lengths[row] - start, capacity)
                at = (np.cumsum(lengths) - lengths)[row] + start
                ids = [flat[a : a + n].tobytes() for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                columns = {
                    "doc_id": part.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def packed(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    With ``with_ids`` also the ids, as little-endian unsigned 32-bit numbers. Null and empty texts
    are one piece that holds the end id alone. Rows with the same doc_id, or equal in all, are
    documents of their own; ties of length are packed in the order of doc_id (null first) and piece.
    An empty table gives no rows. Other columns of ``docs`` are not looked at.

    The tokenised pieces are written once, then numbered by a range-partitioned sort of their small
    rows. Only the histogram, at most ``capacity`` rows, reaches the driver.
    """
    pieces = stage(token_pieces(docs, capacity, tokenizer, end_id, with_ids))
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = with_dense_ids(pieces, order, "rank", start=0)
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = best_fit_decreasing(histogram, capacity)
    kept = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            first, length, per, sequence, offset = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1].T
            columns = {n: batch.column(n) for n in kept}
            columns["sequence_id"] = pa.array(sequence + (rank - first) // per, pa.int64())
            columns["offset"] = pa.array(offset + (rank - first) % per * length, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    kinds = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence, from pieces packed ``with_ids``.

    A sequence has at most as many pieces as it has tokens, so a group is bounded.
    """
    part = F.struct("offset", "ids")
    joined = F.sort_array(F.collect_list(part))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(F.transform(joined, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
    )
