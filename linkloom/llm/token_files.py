"""Token ids in files: a static range asymmetric numeral system over independent blocks.

A folder holds ``frequencies`` (one row per id that occurs, its share of 2**SCALE_BITS; counted over
all documents) and ``blocks``. A block is a run of whole documents and can be read alone: its ids are
dealt to LANES interleaved coders that share the table and one stream of 32-bit words. Every
CHECKPOINT_STEPS steps the state of all lanes and the place in the stream are kept, so that the parts
of a block are decoded side by side. Blocks carry a CRC-32 of their ids and one of their bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.batches import slices, whole_text
from linkloom.llm.encode import encoder
from linkloom.session import shared_folder, stage

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SCALE_BITS = 20
LANES = 2048
CHECKPOINT_STEPS = 128
BLOCK_IDS = 1 << 19
_LOW = np.uint64(1 << 32)
_WORD = np.uint64(32)
_BITS = np.uint64(SCALE_BITS)
BLOCKS = "part int, block int, start long, n_ids long, doc_ids binary, doc_lengths binary, payload binary, ids_crc32 long, payload_crc32 long"


class FrequencyTable:
    """Shares of 2**SCALE_BITS for every id that occurs, at least one each."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids = ids[order].astype(np.uint32)
        self.shares = shares[order].astype(np.uint64)
        self.before = np.cumsum(self.shares) - self.shares

    @classmethod
    def from_counts(cls, ids: np.ndarray, counts: np.ndarray) -> FrequencyTable:
        total = 1 << SCALE_BITS
        if len(ids) > total:
            raise ValueError("more distinct ids than shares")
        if not len(ids):
            return cls(ids, counts)
        spare = total - len(ids)
        exact = counts / counts.sum() * spare
        shares = np.floor(exact).astype(np.int64) + 1
        order = np.lexsort((ids, -(exact - np.floor(exact))))
        shares[order[: total - int(shares.sum())]] += 1
        return cls(ids, shares)

    def dense(self) -> np.ndarray:
        """Place in the table of every id up to the largest."""
        places = np.zeros(int(self.ids.max(initial=0)) + 1, dtype=np.int64)
        places[self.ids] = np.arange(len(self.ids))
        return places

    def slots(self) -> np.ndarray:
        """Place in the table of every one of the 2**SCALE_BITS slots."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.shares.astype(np.int64))


def encode_block(places: np.ndarray, table: FrequencyTable) -> bytes:
    """The ids at ``places`` in the table: number of checkpoints, then states, positions and words.

    Lane j takes ids j, j + LANES, …; lanes are coded from the last step to the first, so a reader
    goes forward. A state lies in [2**32, 2**64) and gives off at most one word a step.
    """
    steps = -(-len(places) // LANES)
    share = table.shares[places]
    before = table.before[places]
    state = np.full(LANES, _LOW, dtype=np.uint64)
    most = np.uint64(64 - SCALE_BITS)
    words: list[np.ndarray] = []
    states: list[np.ndarray] = []
    left: list[int] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        begin = step * LANES
        f = share[begin : begin + LANES]
        x = state[: len(f)]
        over = (x >> most) >= f
        if over.any():
            words.append(x[over].astype("<u4"))
            written += len(words[-1])
            x = np.where(over, x >> _WORD, x)
        q, r = np.divmod(x, f)
        state[: len(f)] = (q << _BITS) + r + before[begin : begin + LANES]
        if step % CHECKPOINT_STEPS == 0:
            states.append(state.copy())
            left.append(written)
    head = np.array([len(states), written], dtype="<u8")
    places_read = written - np.array(left[::-1], dtype="<u8")
    return b"".join(
        [
            head.tobytes(),
            np.array(states[::-1], dtype="<u8").tobytes(),
            places_read.astype("<u8").tobytes(),
            *(w.tobytes() for w in reversed(words)),
        ]
    )


def decode_block(payload: bytes, n_ids: int, table: FrequencyTable, slots: np.ndarray) -> np.ndarray:
    """Places in the table of a block's ids; all checkpointed parts advance together."""
    parts, written = (int(v) for v in np.frombuffer(payload, dtype="<u8", count=2))
    out = np.zeros((parts, CHECKPOINT_STEPS, LANES), dtype=np.int32)
    state = np.frombuffer(payload, dtype="<u8", offset=16, count=parts * LANES).reshape(parts, LANES).copy()
    at = 16 + 8 * parts * LANES
    place = np.frombuffer(payload, dtype="<u8", offset=at, count=parts).astype(np.int64)
    words = np.frombuffer(payload, dtype="<u4", offset=at + 8 * parts, count=written)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    lane = np.arange(LANES)
    part_begin = np.arange(parts) * CHECKPOINT_STEPS * LANES
    rest = table.shares, table.before
    for step in range(CHECKPOINT_STEPS):
        slot = state & mask
        found = slots[slot]
        out[:, step] = found
        fresh = rest[0][found] * (state >> _BITS) + slot - rest[1][found]
        short = fresh < _LOW
        if part_begin[-1] + (step + 1) * LANES > n_ids:  # some lanes of the last part have ended
            live = part_begin[:, None] + step * LANES + lane < n_ids
            fresh = np.where(live, fresh, state)
            short &= live
        state = fresh
        taken = short.sum(axis=1)
        if taken.any():
            row, col = np.nonzero(short)
            first = np.cumsum(taken) - taken
            index = place[row] + np.arange(len(row)) - first[row]
            state[row, col] = (state[row, col] << _WORD) | words[index].astype(np.uint64)
            place += taken
    return out.reshape(-1)[:n_ids]


def id_rows(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """The ids of every document, and one row of counts by id for every task.

    doc_id and ids, as compressed little-endian 32-bit numbers; rows of counts have ``counts`` instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaced=True).encode
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found = encode(part.column("text").to_pylist())
                ends = np.cumsum(found["lengths"])
                flat = np.insert(found["ids"], ends, end_id).astype("<u4")
                counts = np.bincount(flat, minlength=len(total))
                counts[: len(total)] += total
                total = counts
                lengths = found["lengths"] + 1
                last = np.cumsum(lengths)
                # byte planes: the upper two bytes of nearly all ids are zero
                ids = [
                    pack.compress(flat[a:b].view(np.uint8).reshape(-1, 4).T.tobytes())
                    for a, b in zip((last - lengths).tolist(), last.tolist(), strict=True)
                ]
                yield _id_batch(part.column("doc_id"), ids, [None] * len(ids))
        yield _id_batch(pa.array([None], pa.int64()), [None], [pack.compress(total.astype("<i8").tobytes())])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, counts binary")


def _id_batch(doc_ids: pa.Array, ids: list, counts: list) -> pa.RecordBatch:
    columns = {"doc_id": doc_ids, "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary())}
    return pa.RecordBatch.from_pydict(columns)


def _unpacked(packed: bytes, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(unpack.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def id_counts(rows: DataFrame) -> DataFrame:
    """id and n over all documents: the tasks' counts, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed in batch.column("counts").to_pylist():
                counts = np.frombuffer(unpack.decompress(packed), dtype="<i8")
                ids = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(counts[ids], pa.int64())})

    told = rows.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long")
    return told.groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(ranged: DataFrame, table: FrequencyTable) -> DataFrame:
    """Blocks of whole documents, in the order of the partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unpack = zstandard.ZstdDecompressor()
        dense = table.dense()
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def closed() -> pa.RecordBatch:
            flat = np.concatenate([ids for _, ids in held])
            payload = encode_block(dense[flat], table)
            lengths = np.array([len(ids) for _, ids in held], dtype="<i8")
            keys = pa.record_batch({"k": pa.array([k for k, _ in held], pa.int64())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, keys.schema) as writer:
                writer.write_batch(keys)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "start": pa.array([start], pa.int64()),
                    "n_ids": pa.array([len(flat)], pa.int64()),
                    "doc_ids": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                    "doc_lengths": pa.array([lengths.tobytes()], pa.binary()),
                    "payload": pa.array([payload], pa.binary()),
                    "ids_crc32": pa.array([zlib.crc32(flat.tobytes())], pa.int64()),
                    "payload_crc32": pa.array([zlib.crc32(payload)], pa.int64()),
                }
            )

        for batch in batches:
            for key, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append((key, _unpacked(packed, unpack)))
                size += len(held[-1][1])
                if size >= BLOCK_IDS:
                    yield closed()
                    block, start = block + 1, start + size
                    held, size = [], 0
        if held:
            yield closed()

    return ranged.mapInArrow(run, BLOCKS)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Write the ids of all documents in ascending doc_id order below ``folder``.

    Null and empty texts are the end id alone. Null doc_ids come first; rows that share a doc_id are
    documents of their own, in the order of their ids' bytes. Only the frequency table, bounded by
    the vocabulary, reaches the driver.
    """
    spark = docs.sparkSession
    rows = stage(id_rows(docs, tokenizer, end_id))
    counts = id_counts(rows).toPandas()
    table = FrequencyTable.from_counts(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))
    shares = pa.table({"id": pa.array(table.ids, pa.int64()), "share": pa.array(table.shares.astype(np.int64))})
    spark.createDataFrame(shares).coalesce(1).write.parquet(f"{folder}/frequencies")
    ranged = rows.where("counts IS NULL").select("doc_id", "ids").repartitionByRange("doc_id", F.xxhash64("ids"))
    ranged = ranged.sortWithinPartitions("doc_id", "ids")
    _blocks(ranged, table).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files.

    ``start`` counts the ids of all documents before. With ``with_ids`` also the ids themselves. A
    block whose bytes or ids do not fit its checksums raises an error.
    """
    shares = spark.read.parquet(f"{folder}/frequencies").toPandas()
    table = FrequencyTable(shares["id"].to_numpy(np.int64), shares["share"].to_numpy(np.int64))
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.slots()
        for batch in batches:
            for b in batch.to_pylist():
                if zlib.crc32(b["payload"]) != b["payload_crc32"]:
                    raise ValueError(f"damaged bytes in block {b['part']}/{b['block']}")
                flat = table.ids[decode_block(b["payload"], b["n_ids"], table, slots)].astype("<u4")
                if zlib.crc32(flat.tobytes()) != b["ids_crc32"]:
                    raise ValueError(f"damaged ids in block {b['part']}/{b['block']}")
                lengths = np.frombuffer(b["doc_lengths"], dtype="<i8")
                ends = np.cumsum(lengths)
                ids = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = {
                    "part": pa.array(np.full(len(lengths), b["part"]), pa.int32()),
                    "doc_id": pa.ipc.open_stream(b["doc_ids"]).read_all().column("k").combine_chunks(),
                    "place": pa.array(b["start"] + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    kinds = "part int, doc_id long, place long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    # one row per written partition: bounded by the number of shuffle partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    found = blocks.mapInArrow(run, kinds).join(F.broadcast(parts), "part")
    rest = ["n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return found.select("doc_id", (F.col("place") + F.col("part_start")).alias("start"), *rest)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
