"""N-gram Jaccard join by PartEnum signatures, and the classes it links documents into.

Two sets of sizes a and b with Jaccard similarity of p percent differ in at most
(a + b)(100 - p)/(100 + p) members. Sizes are cut into bands, and a band has a bound k on that
difference. The feature domain (64-bit shingle hashes) is cut into first-level parts, each of them
into second-level parts; a set's signatures are the hashes of what it has in every choice of
``keep`` second-level parts of one first-level part. Two sets that differ in at most k members agree
in a whole choice in more than ``spare`` first-level parts, so similar sets share a signature: no
link is lost. A choice in which a set has nothing is no signature; sets with nothing in more than
``spare`` first-level parts sign those parts as well, which keeps the guarantee.

The same guarantee keeps common passages from bringing everything together. A signature of members that
very many sets have makes a crowded group, whose pairs grow with the square of the input. A set that has at
most ``spare`` parts in crowded groups, or with nothing in them, shares one more signature with each similar
set, which is not crowded: it is not compared in its crowded groups. Those that stay there are few.

Sharing a signature only names candidates. They are compared with the smallest document of their
group first, not pair by pair; groups whose documents are then one class are done, however large. Of
groups with the same documents one is kept. What is left is compared within groups, block by block: each
document in the largest of its groups, then in all that still hold several classes. That goes in rounds: first some FIRST partners of each document, by a hash of the pair, then four times as many, and
so on until every pair had its turn. Groups whose documents have become one class drop out after each
round, so few come to the later ones, as do those whose pairs all had their turn. Counts of shingles in cells are compared first: their differences
add up to no more than the sets differ, so what exceeds the bound is no link. They tell little of large
sets: of what is left parities of cells are compared, twice as many as the sets have members, by the same
argument. Only the rest is compared text by text. Documents of groups of more than MOST get the signatures of the next, more
selective level instead; only on the last one blocks are made of groups of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.batches import free_name, release, runs, slices, whole_text
from linkloom.llm.components import components
from linkloom.llm.shingles import mixed, shingle_sets
from linkloom.session import arrow_batches, delete_folder, new_scope, stage

BROADCAST_IDS = 200_000
GROUP = 512  # rows that are compared in one place; larger groups come in blocks of so many
MOST = 2 * GROUP  # still larger groups are signed on the next level
CROWD = 64  # nodes; what stays in larger groups are only those that have more of them than they can do without
SKETCH = 64  # cells, a byte each
FINE = 128  # cells that are compared within groups
BATCH_ROWS = 2000  # that a Python function gets at once; a pair has two whole texts
SLICE = 1 << 18  # bytes of text that are hashed at once
COMPARED = 8192  # pairs of sketches at a time
PAIRS = 1 << 17  # pairs that are named at a time
FIRST = 8  # partners a document is compared with in the first round
FILTER_BITS = 1 << 27  # at most, of the filter of shared signatures
HOT_SHARE = 1000  # equal sets of more than 1/HOT_SHARE of all rows are hot; there are fewer than that many


class Scheme(NamedTuple):
    """How the sets of one size band are signed."""

    number: int
    parts: int
    split: int
    keep: int
    spare: int


def band_starts(percent: int, largest: int) -> list[int]:
    """First size of every band up to ``largest``; a band spans two similarity ratios."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(_band_end(starts[-1], percent) + 1)
    return starts


def _band_end(start: int, percent: int) -> int:
    return max(start, start * 10_000 // percent**2)


def scheme(band: int, start: int, percent: int, level: int) -> Scheme:
    """Parts and choices for a band. Choices cover more of the set on every level."""
    k = 2 * _band_end(start, percent) * (100 - percent) // (100 + percent)
    if k <= 3:
        return Scheme(band, 1, k + 3 + level if k else 1, 3 + level if k else 1, 0)
    miss = (1 if k <= 40 else 0, 2, 3)[level]
    split = (3 if k <= 40 else 1, 5, 8)[level]
    parts = -(-(k + 1) // (miss + 1))
    spare = 2 + parts // 8
    return Scheme(band, parts + spare, split, split - miss, spare)


LEVELS = 3


def signatures(members: np.ndarray, percent: int, level: int, starts: list[int]) -> np.ndarray:
    """Signatures of one set of distinct 64-bit members."""
    return signed(members, percent, level, starts)[0]


def signed(members: np.ndarray, percent: int, level: int, starts: list[int]) -> tuple[np.ndarray, int]:
    """Signatures of one set, the last bit of which tells a set's bands apart, and its room.

    Room is how many signatures of a band the set can do without: of the parts in which similar sets
    agree, ``spare`` + 1 at least, it may lack those in which it has nothing, and so many more.
    """
    size = len(members)
    band = int(np.searchsorted(starts, size, side="right")) - 1
    bands = [band]
    if size * 100 // percent >= starts[band + 1]:
        bands.append(band + 1)
    out, room = [], []
    for number in bands:
        s = scheme(number, starts[number], percent, level)
        cells = s.parts * s.split
        key = mixed(members, 11 + level)
        cell = ((key >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
        order = np.argsort(cell, kind="stable")
        sorted_cell = cell[order].astype(np.int64)
        first = np.flatnonzero(np.diff(sorted_cell, prepend=-1))
        sums = np.zeros(cells, dtype=np.uint64)
        filled = np.zeros(cells, dtype=bool)
        sums[sorted_cell[first]] = np.add.reduceat(mixed(members, 23)[order], first)
        filled[sorted_cell[first]] = True
        sums, filled = sums.reshape(s.parts, s.split), filled.reshape(s.parts, s.split)
        chosen = [list(c) for c in combinations(range(s.split), s.keep)]
        values = np.stack([sums[:, c].sum(axis=1, dtype=np.uint64) for c in chosen], axis=1)
        some = np.stack([filled[:, c].any(axis=1) for c in chosen], axis=1)
        place = np.arange(s.parts * len(chosen), dtype=np.uint64).reshape(values.shape)
        tag = mixed(place, 1000 * (level + 1) + number)
        own = [mixed(values ^ tag)[some]]
        lacking = int((~some.all(axis=1)).sum())
        if lacking > s.spare:
            own.append(mixed(tag[~some], 5))
        out += [x & ~np.uint64(1) | np.uint64(number & 1) for x in own]
        room.append(max(s.spare - lacking, 0))
    return np.concatenate(out), min(room)


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


CELLS = tuple(f"s{i}" for i in range(SKETCH // 8))
FINE_CELLS = tuple(f"f{i}" for i in range(FINE // 8))


def sketch(members: np.ndarray, cells: int = SKETCH) -> np.ndarray:
    """How many members lie in each cell, at most 255, packed into longs."""
    counts = np.bincount((members >> np.uint64(64 - (cells - 1).bit_length())).astype(np.int64), minlength=cells)
    return np.minimum(counts, 255).astype(np.uint8).view(np.int64)


def odd_sketch(members: np.ndarray) -> bytes:
    """Whether an odd number of members lies in each cell, a bit each; two cells a member at least."""
    cells = 1 << max(6, (2 * len(members) - 1).bit_length())
    at = (members & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells).astype(np.uint8) & 1).tobytes()


def odd_distance(x: bytes, y: bytes) -> int:
    """Cells in which two odd sketches differ, each of which holds a member that only one set has.

    The larger is folded to the cells of the smaller: a member's cell is told by its last bits.
    """
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def set_digests(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest and all sketches of the shingle set, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text"), words)
                digest = [[int(mixed(s, seed).sum(dtype=np.uint64)) for s in sets] for seed in (41, 43)]
                sketches = [(CELLS, SKETCH), (FINE_CELLS, FINE)]
                cells = [np.array([sketch(s, n) for s in sets], dtype=np.int64).reshape(-1, len(names)) for names, n in sketches]
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "h1": pa.array(np.array(digest[0], dtype=np.uint64).view(np.int64), pa.int64()),
                    "h2": pa.array(np.array(digest[1], dtype=np.uint64).view(np.int64), pa.int64()),
                }
                for (names, _), own in zip(sketches, cells, strict=True):
                    columns |= {name: pa.array(own[:, i], pa.int64()) for i, name in enumerate(names)}
                columns["odd"] = pa.array([odd_sketch(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)
        release()

    kinds = ", ".join(f"{c} long" for c in CELLS + FINE_CELLS)
    return _text_rows(docs).mapInArrow(run, f"doc_id long, n_shingles long, h1 long, h2 long, {kinds}, odd binary")


def _matrix(batch: pa.RecordBatch, suffix: str = "", names: tuple[str, ...] = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as bytes, and sizes; a size below zero stands for an id with several sets."""
    cells = np.column_stack([batch.column(c + suffix).to_numpy() for c in names])
    return np.ascontiguousarray(cells).view(np.uint8).astype(np.int16), batch.column("size" + suffix).to_numpy()


def _sizes_fit(size_a, size_b, percent: int) -> np.ndarray:
    """False where sizes prove that two sets are no link."""
    return (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) | (size_a < 0) | (size_b < 0)


def _may_link(cells_a, size_a, cells_b, size_b, percent: int) -> np.ndarray:
    """False where sizes or sketches prove that two sets are no link."""
    apart = np.abs(cells_a - cells_b).sum(axis=-1, dtype=np.int64)
    fits = apart * (100 + percent) <= (size_a + size_b) * (100 - percent)
    return (fits | (size_a < 0) | (size_b < 0)) & _sizes_fit(size_a, size_b, percent)


def possible_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array(_may_link(*_matrix(batch, "_a", FINE_CELLS), *_matrix(batch, "_b", FINE_CELLS), percent), pa.bool_())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(mask) for c in ("a", "b")})

    nodes = nodes.select("node", "size", *FINE_CELLS)
    sides = [nodes.withColumnsRenamed({c: f"{c}_{x}" for c in nodes.columns}) for x in ("a", "b")]
    met = pairs.join(sides[0], F.col("a") == F.col("node_a")).join(sides[1], F.col("b") == F.col("node_b"))
    return met.mapInArrow(run, "a long, b long")


def close_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the odd sketches of ``sets`` (doc_id, n_shingles, odd) do not rule out.

    An id with several sets is compared with each of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_shingles_a", "odd_a", "n_shingles_b", "odd_b"))
            near = [
                odd_distance(x, y) * (100 + percent) <= (n + m) * (100 - percent)
                for n, x, m, y in zip(*columns, strict=True)
            ]
            mask = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(mask) for c in ("a", "b")})

    left, right = (
        sets.select(F.col("doc_id").alias(f"of_{x}"), F.col("n_shingles").alias(f"n_shingles_{x}"), F.col("odd").alias(f"odd_{x}"))
        for x in ("a", "b")
    )
    named = pairs.select("a", "b")
    if _few(pairs):  # then just the sketches that are compared are shuffled
        named = F.broadcast(named)
        right = right.join(F.broadcast(pairs.select(F.col("b").alias("kb")).distinct()), F.col("of_b") == F.col("kb"), "left_semi")
    met = left.join(named, F.col("of_a") == F.col("a")).join(right, F.col("b") == F.col("of_b"))
    return met.mapInArrow(run, "a long, b long").distinct()


def _few(pairs: DataFrame) -> bool:
    return pairs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def partners_before(turn: int) -> int:
    """How many partners of each document had their turn before a round; groups of no more rows are done."""
    return FIRST * (4**turn - 1) // 3


def turns(n: int) -> list[tuple[float, float]]:
    """The share of all pairs, by their hash, that has its turn in each round of a group of ``n``."""
    ends = [0.0]
    while ends[-1] < 1:
        ends.append(min(1.0, partners_before(len(ends)) / max(n, 1)))
    return list(zip(ends, ends[1:]))


def group_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of nodes of one group and different components that have their turn in a round and that
    their sketches do not rule out.

    ``rows``: signature, node, component, size and fine sketch. A group is bounded, and is compared
    where its rows lie, many small ones together; only pairs that may be links leave the task.
    """

    def pairs(batch: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(bounds)
        spans = {n: turns(n)[turn] if turn < len(turns(n)) else (0.0, 0.0) for n in np.unique(sizes).tolist()}
        low, high = (np.repeat([int(spans[n][side] * 2**53) for n in sizes.tolist()], sizes).astype(np.uint64) for side in (0, 1))
        partners = np.where(high > low, np.repeat(bounds[1:], sizes) - np.arange(len(batch)) - 1, 0)
        cells, size = _matrix(batch, names=FINE_CELLS)
        node, component = batch.column("node").to_numpy(), batch.column("component").to_numpy()
        ends = np.cumsum(partners)
        begin = 0
        while begin < len(batch):  # rows with some PAIRS partners in all
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            own = np.arange(begin, end)
            i = np.repeat(own, partners[begin:end])
            j = runs(own + 1, partners[begin:end])
            begin = end
            kept = (component[i] != component[j]) & _sizes_fit(size[i], size[j], percent)
            i, j = i[kept], j[kept]
            least, most = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            place = mixed(mixed(least.view(np.uint64), 61) + most.view(np.uint64), 62) >> np.uint64(11)
            kept = (place >= low[i]) & (place < high[i])
            i, j, least, most = i[kept], j[kept], least[kept], most[kept]
            for at in range(0, len(i), COMPARED):
                some = slice(at, at + COMPARED)
                may = _may_link(cells[i[some]], size[i[some]], cells[j[some]], size[j[some]], percent)
                if may.any():
                    yield pa.RecordBatch.from_pydict({"a": pa.array(least[some][may]), "b": pa.array(most[some][may])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
            batch = table.combine_chunks().to_batches()[0]
            signature = batch.column("signature").to_numpy()
            bounds = np.append(np.flatnonzero(np.diff(signature, prepend=signature[0] - 1)), len(signature))
            yield from pairs(batch, bounds)

        for batch in batches:
            signature = batch.column("signature").to_numpy()
            if not len(signature):
                continue
            first = int(np.searchsorted(signature, signature[-1], side="left"))
            whole = [*rest, batch.slice(0, first)] if first else []
            if not first and rest and rest[-1].column("signature")[-1].as_py() != signature[0]:
                whole, rest = rest, []
            if whole:
                table = pa.Table.from_batches(whole)
                if table.num_rows:
                    yield from compared(table)
                rest = []
            rest.append(batch.slice(first))
        if rest:
            yield from compared(pa.Table.from_batches(rest))
        release()

    return rows.repartition("signature").sortWithinPartitions("signature").mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Groups larger than GROUP as groups of two blocks each, so that every pair meets in one."""
    blocks = F.ceil(F.col("n_nodes") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    key = F.xxhash64("signature", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.withColumn("signature", key).drop("blocks", "own", "other")


def signature_rows(docs: DataFrame, words: int, percent: int, level: int) -> DataFrame:
    """signature, doc_id and room. Of equal sets in one task only the first signs; they are one class anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        starts = band_starts(percent, 1 << 16)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text"), words)
                largest = max(map(len, sets), default=0)
                if largest >= starts[-2]:
                    starts = band_starts(percent, 2 * largest)
                found, rooms, ids = [], [], []
                for key, members in zip(part.column("doc_id").to_pylist(), sets, strict=True):
                    if not len(members):
                        continue
                    digest = (len(members), int(mixed(members, 41).sum(dtype=np.uint64)))
                    if digest in seen:
                        continue
                    seen.add(digest)
                    own, room = signed(members, percent, level, starts)
                    found.append(own)
                    rooms.append(room)
                    ids.append(key)
                if not found:
                    continue
                of = pa.array(np.repeat(np.arange(len(ids)), [len(f) for f in found]))
                yield pa.RecordBatch.from_pydict(
                    {
                        "signature": pa.array(np.concatenate(found).view(np.int64), pa.int64()),
                        "doc_id": pa.array(ids, pa.int64()).take(of),
                        "room": pa.array(rooms, pa.int32()).take(of),
                    }
                )
        release()

    return _text_rows(docs).mapInArrow(run, "signature long, doc_id long, room int")


def linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity, compared member by member.

    Texts are shuffled for those only that the odd sketches of ``sets`` leave.
    """
    pairs = stage(close_pairs(pairs, sets, percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in slices(batch, "text_a", SLICE):
                for part in slices(half, "text_b", SLICE):
                    left, right = (shingle_sets(part.column(c), words) for c in ("text_a", "text_b"))
                    good = []
                    for x, y in zip(left, right, strict=True):
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        good.append(len(x) > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                    mask = pa.array(good, pa.bool_())
                    yield pa.RecordBatch.from_pydict(
                        {"a": part.column("a").filter(mask), "b": part.column("b").filter(mask)}
                    )

    texts = _text_rows(docs).withColumnRenamed("doc_id", "of")
    left, right = pairs, texts
    if _few(pairs):  # then just the texts that are compared are shuffled
        left = F.broadcast(pairs)
        right = texts.join(F.broadcast(pairs.select(F.col("b").alias("kb")).distinct()), F.col("of") == F.col("kb"), "left_semi")
    met = texts.join(left, F.col("of") == F.col("a")).select("a", "b", F.col("text").alias("text_a"))
    met = met.join(right, F.col("b") == F.col("of")).select("a", "b", "text_a", F.col("text").alias("text_b"))
    return met.mapInArrow(run, "a long, b long").distinct()


def _shared_filter(shared: DataFrame) -> np.ndarray:
    """Bits of the signatures in ``shared``, FILTER_BITS at most; more signatures let more others pass."""
    bits = 1 << max(12, min(8 * shared.count(), FILTER_BITS - 1).bit_length())
    at = F.col("signature").bitwiseAND(F.lit(bits - 1))
    cell = F.shiftrightunsigned(at, 6).alias("cell")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = shared.select(cell, bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    filled = np.zeros(bits // 64, dtype=np.uint64)
    filled[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return filled


def _passing(rows: DataFrame, filled: np.ndarray) -> DataFrame:
    """The rows whose signature the filter holds."""
    sent = rows.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("signature").to_numpy().view(np.uint64) & np.uint64(64 * len(sent.value) - 1)
            bits = sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))
            yield batch.filter(pa.array(bits & np.uint64(1) == 1, pa.bool_()))

    return rows.mapInArrow(run, "signature long, doc_id long, room int")


def _groups(rows: DataFrame, class_of: DataFrame) -> DataFrame:
    """Rows of signatures that several classes share: signature, node, room, pivot, n_nodes, weight, odd.

    Nearly all signatures are one document's alone: they end in the sums, and a filter of the others
    keeps them from being shuffled with their documents. All rows are deleted as soon as those of
    shared signatures are written. Of groups with the same nodes the first is kept; ``weight`` is how many
    there are, and ``odd`` how many of those are of bands with odd numbers.
    """
    spark = rows.sparkSession
    written = new_scope(spark)
    rows = stage(rows, written)
    shared = stage(rows.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("signature"))
    met = _passing(rows, _shared_filter(shared))
    met = met.join(shared.select(F.col("signature").alias("s")), F.col("signature") == F.col("s")).select("signature", "doc_id", "room")
    nodes = met.join(class_of.select(F.col("doc_id").alias("k"), "node"), F.col("doc_id") == F.col("k"))
    nodes = stage(nodes.groupBy("signature", "node").agg(F.min("room").alias("room")))
    delete_folder(spark, written)
    sizes = nodes.groupBy("signature").agg(
        F.min("node").alias("pivot"),
        F.count(F.lit(1)).alias("n_nodes"),
        *[F.bit_xor(F.xxhash64("node", F.lit(n))).alias(f"x{n}") for n in range(2)],
    )
    sizes = sizes.where("n_nodes > 1").groupBy("pivot", "n_nodes", "x0", "x1").agg(
        F.min("signature").alias("s"), F.count(F.lit(1)).alias("weight"), F.sum(F.col("signature").bitwiseAND(F.lit(1))).alias("odd")
    )
    return nodes.join(sizes, F.col("signature") == F.col("s")).select("signature", "node", "room", "pivot", "n_nodes", "weight", "odd")


def _uncrowded(groups: DataFrame) -> DataFrame:
    """signature, node and n_nodes of what has to be compared in ``groups``.

    Nodes that have room for all their crowded groups leave those: they meet each similar set in a
    group that is not crowded, or is one class and so not among ``groups``.
    """
    rows = ("signature", "node", "n_nodes")
    crowded = groups.where(F.col("n_nodes") > CROWD)
    odd = F.sum("odd")
    bound = crowded.groupBy("node").agg((F.greatest(odd, F.sum("weight") - odd) > F.min("room")).alias("bound")).where("bound")
    stay = stage(crowded.join(bound.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left_semi").select("signature", "node"))
    sizes = stay.groupBy(F.col("signature").alias("s")).agg(F.count(F.lit(1)).alias("n_nodes")).where("n_nodes > 1")
    stay = stay.join(sizes, F.col("signature") == F.col("s")).select(*rows)
    return groups.where(F.col("n_nodes") <= CROWD).select(*rows).unionByName(stay)


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests of all rows, the node of every doc_id, and the component of every node with a link."""
    known = docs.where(F.col("doc_id").isNotNull())
    digests = stage(set_digests(docs, words))
    same = ["n_shingles", "h1", "h2"]
    real = digests.where("doc_id IS NOT NULL AND n_shingles > 0")
    placed = _placed(real.select("doc_id", *same), same)
    # an id with several sets is a node of its own, has no sketch, and is tied to the classes of its sets
    several = F.lit(False)
    for c in same:
        several = several | (F.min(c) < F.max(c))
    class_of = placed.groupBy("doc_id").agg(several.alias("several"), F.min("node").alias("node"), F.min("n_shingles").alias("size"))
    class_of = stage(class_of.withColumn("node", F.when(F.col("several"), F.col("doc_id")).otherwise(F.col("node"))))
    nodes = class_of.where(F.col("doc_id") == F.col("node"))
    nodes = nodes.select("node", F.when(F.col("several"), -1).otherwise(F.col("size")).alias("size"))
    sketches = real.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in CELLS + FINE_CELLS])
    nodes = stage(nodes.join(sketches, F.col("node") == F.col("doc_id")).drop("doc_id"))
    mixed = class_of.where("several").select(F.col("doc_id").alias("b"))
    if mixed.isEmpty():
        links = mixed.select(F.col("b").alias("a"), "b")
    else:
        ties = placed.select("doc_id", F.col("node").alias("a")).join(mixed, F.col("doc_id") == F.col("b"))
        links = ties.where("a <> b").select("a", "b").distinct()
    label = components(links)
    done, signing = None, known
    for level in range(LEVELS):
        groups = stage(_groups(signature_rows(signing, words, percent, level), class_of))
        star = groups.where("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.sum("weight").alias("count"))
        star = stage(star if done is None else star.join(done, ["a", "b"], "left_anti"))
        # each document with the one that it shares most signatures with; the others only if that
        # leaves the two in different classes
        most = star.groupBy("b").agg(F.max(F.struct("count", -F.col("a"))).alias("best"))
        most = most.select((-F.col("best.col2")).alias("a"), "b")
        label = _joined(label, linked(stage(possible_pairs(most, nodes, percent)), real, known, words, percent))
        apart = star.join(most, ["a", "b"], "left_anti").select("a", "b")
        label = _joined(label, linked(stage(possible_pairs(_apart(apart, label), nodes, percent)), real, known, words, percent))
        star = star.select("a", "b")
        done = star if done is None else done.unionByName(star)
        left = _uncrowded(stage(_undecided(groups, label).where("n_nodes > 2").drop("component")))
        last = level == LEVELS - 1
        blocks = (F.col("n_nodes") > GROUP) & (F.lit(last) | (F.col("n_nodes") <= MOST))
        left = stage(left)
        if left.isEmpty():
            break
        close = left.where(F.col("n_nodes") <= GROUP).unionByName(in_blocks(left.where(blocks)))
        close = stage(close.select("signature", "node"))
        # each document in the largest of its groups first; what they join need not be compared in the others
        sizes = close.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
        largest = close.join(sizes.withColumnRenamed("signature", "s"), F.col("signature") == F.col("s"))
        largest = largest.groupBy("node").agg(F.max(F.struct("n", "signature")).alias("best"))
        largest = stage(largest.select("best.signature", "node"))
        for rows, rounds in ((largest, 2), (close, len(turns(2 * GROUP)))):
            for turn in range(rounds):
                rows = stage(_undecided(rows, label, partners_before(turn)))
                if rows.isEmpty():
                    break
                sketched = rows.join(nodes.select(F.col("node").alias("of"), "size", *FINE_CELLS), F.col("node") == F.col("of")).drop("of")
                pairs = group_pairs(sketched, percent, turn).distinct()
                pairs = stage(pairs.join(done, ["a", "b"], "left_anti"))
                label = _joined(label, linked(pairs, real, known, words, percent))
                done = done.unionByName(pairs)
        if last:
            break
        rest = stage(left.where(F.col("n_nodes") > MOST).select("node").distinct())
        if rest.isEmpty():
            break
        signing = known.join(_sized(rest), F.col("doc_id") == F.col("node"), "left_semi")
    return digests, class_of, label


def near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: classes of texts linked by similarity.

    Texts are lower-cased (A-Z) and cut at white space; a text's set are its distinct shingles of
    ``words`` words, a shorter text's whole sequence is one. Two documents link when
    100 * common >= percent * union. A text that is null or has no words has no shingle and no link.
    component_id is the smallest doc_id reachable; a document without links is its own. Rows that
    share a doc_id are one node: each is returned, and they are linked through their id. Rows without
    doc_id are returned with null and are never linked. An empty table gives no rows; other columns
    are not looked at.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent has to lie between 50 and 100")
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        digests, class_of, label = _classes(_text_rows(docs), words, percent)
    named = class_of.select("doc_id", "node").join(label.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    named = named.select("doc_id", F.coalesce("component", "node").alias("component_id"))
    keyed = named.withColumnRenamed("doc_id", "k")
    return digests.join(keyed, F.col("doc_id") == F.col("k"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _placed(real: DataFrame, same: list[str]) -> DataFrame:
    """Rows with ``node``, the smallest doc_id of the same set.

    Very many rows may have one set. Nodes of hot sets are broadcast, which are fewer than HOT_SHARE by
    arithmetic; those of all others are joined by a shuffle.
    """
    classes = stage(real.groupBy(*same).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")))
    every = classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    is_hot = F.col("rows") * HOT_SHARE > every
    marked = real.join(F.broadcast(classes.where(is_hot).select(*same, F.col("node").alias("hot_node"))), same, "left")
    warm = marked.where("hot_node IS NOT NULL").withColumnRenamed("hot_node", "node")
    cold = marked.where("hot_node IS NULL").drop("hot_node").join(classes.where(~is_hot).select(*same, "node"), same)
    return cold.unionByName(warm)


def _undecided(rows: DataFrame, label: DataFrame, above: int = 0) -> DataFrame:
    """The rows, with their component, of groups (signature, node) of more than ``above`` rows that hold several."""
    own = label.select(F.col("node").alias("of"), F.col("component").alias("other"))
    named = rows.drop("component").join(own, F.col("node") == F.col("of"), "left")
    named = named.withColumn("component", F.coalesce("other", "node")).drop("of", "other")
    several = named.groupBy("signature").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    several = several.where((F.col("lo") < F.col("hi")) & (F.col("n") > above)).select(F.col("signature").alias("s"))
    return named.join(several, F.col("signature") == F.col("s"), "left_semi")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component."""
    for side in ("a", "b"):
        own = label.select(F.col("node").alias("of"), F.col("component").alias(f"c{side}"))
        pairs = pairs.join(own, F.col(side) == F.col("of"), "left").drop("of")
        pairs = pairs.withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return pairs.where("ca <> cb").select("a", "b")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; what is known already enters as one link to each component."""
    links = stage(links)
    if links.isEmpty():
        return label
    known = label.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return stage(components(known.unionByName(links)))


def one_of_each(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The documents, all columns, with the smallest doc_id of each class; of an id's rows the first by text.

    Documents without doc_id stay. The ids that go are joined where the documents are while there
    are at most BROADCAST_IDS of them; more are joined by a shuffle.
    """
    found = stage(near_duplicates(docs, words, percent).where("doc_id IS NOT NULL"))
    name, copy = free_name(docs, "gone_id"), free_name(docs, "copy_no")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    again = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name))
    key = docs["doc_id"].cast("long")
    kept = docs.join(_sized(gone), key == F.col(name), "left_anti")
    if again.isEmpty():
        return kept
    again = _sized(stage(again))
    once = kept.join(again, kept["doc_id"].cast("long") == again[name], "left_anti")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    first = kept.join(again, kept["doc_id"].cast("long") == again[name], "left_semi")
    first = first.withColumn(copy, F.row_number().over(order)).where(F.col(copy) == 1).drop(copy)
    return once.unionByName(first)


def _sized(ids: DataFrame) -> DataFrame:
    ids = stage(ids)
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
