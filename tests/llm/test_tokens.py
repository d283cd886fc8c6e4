"""Packing, token files and token counts against plain versions."""

import bisect
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import attribution, packing, token_files
from linkloom.llm.encode import encoder

TEXTS = [
    "", None, "a", "It's  a\n\n test \n", " lead", "tail \n", "\t\ttabs x", "Ünïcode 日本語 don't",
    "<|endoftext|> plain", "word " * 3000, "x" * 5000, "a\x00b c", "Same text.", "Same text.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(3, "again", "clash", 7), (None, "no id", "c", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, START int").repartition(3)


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB'sĳé́1. \n\t\x85\xa0\x1cİΣ<|>", max_size=40))
def test_words_encode_as_whole_texts(text):
    for file, spaced in ((packing.TOKENIZER, False), (attribution.TOKENIZER, True)):
        for offsets in (False, True):
            used = encoder(file, spaced, offsets)
            want = used.tokenizer.encode(text, add_special_tokens=False)
            got = used.encode([text, "x", text])
            n = len(want.ids)
            assert got["lengths"].tolist()[::2] == [n, n]
            assert got["ids"][:n].tolist() == got["ids"][len(got["ids"]) - n :].tolist() == want.ids
            if offsets:
                assert list(zip(got["begins"][:n], got["ends"][:n], strict=True)) == want.offsets


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time."""
    rooms, sequences = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        sequences += room == capacity
        if room > n:
            bisect.insort(rooms, room - n)
    return sequences, sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 47))
def test_runs_pack_as_one_by_one(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.best_fit_decreasing(histogram, capacity)
    filled = {}
    ends = np.append(runs[1:, 0], len(lengths))[: len(runs)]
    for (rank, length, per, first, offset), end in zip(runs.tolist(), ends.tolist(), strict=True):
        for i in range(end - rank):
            filled.setdefault(first + i // per, []).append((offset + i % per * length, length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    sequences, rooms = one_by_one(lengths, capacity)
    assert len(filled) == sequences
    left = sorted(capacity - sum(n for _, n in p) for p in filled.values())
    assert [r for r in left if r] == rooms


def test_packed_rows(docs):
    pieces = packing.packed(docs, capacity=512, with_ids=True).toPandas()
    encode = encoder(packing.TOKENIZER, False).tokenizer.encode
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = []
    for doc_id, text in rows:
        ids = [*encode(text, add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 512)):
            cut = np.array(ids[start : start + 512], dtype="<u4").tobytes()
            want.append((-1 if doc_id is None else doc_id, piece, start, len(cut) // 4, zlib.crc32(cut)))
    got = pieces.fillna({"doc_id": -1})
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).values)) == sorted(want)
    for _, group in pieces.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group.offset.tolist() == (group.length.cumsum() - group.length).tolist()
        assert group.length.sum() <= 512
    assert pieces.sequence_id.nunique() == one_by_one([w[3] for w in want], 512)[0]
    whole = packing.sequences(docs.sparkSession.createDataFrame(pieces)).toPandas()
    assert (whole.ids.map(len) == 4 * whole.n_tokens).all()
    assert whole.n_tokens.sum() == sum(w[3] for w in want)


def test_packing_nothing(spark):
    assert packing.packed(nothing(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 3000), st.integers(0, 10**6))
def test_blocks_round_trip(n, kinds, seed):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.3, n), kinds).astype(np.int64) * 7
    present, counts = np.unique(ids, return_counts=True)
    table = token_files.FrequencyTable.from_counts(present, counts.astype(float))
    assert table.shares.sum() == 1 << token_files.SCALE_BITS and table.shares.min() > 0
    payload = token_files.encode_block(table.dense()[ids], table)
    assert (table.ids[token_files.decode_block(payload, n, table, table.slots())] == ids).all()


def test_long_block_with_checkpoints():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50257, 300_001)
    present, counts = np.unique(ids, return_counts=True)
    table = token_files.FrequencyTable.from_counts(present, counts.astype(float))
    payload = token_files.encode_block(table.dense()[ids], table)
    assert (table.ids[token_files.decode_block(payload, len(ids), table, table.slots())] == ids).all()
    assert len(payload) < 300_001 * 2.1


def test_token_files(spark, docs, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write_token_files(docs, folder)
    got = token_files.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    encode = encoder(token_files.TOKENIZER, True).tokenizer.encode
    rows = [(r.doc_id, [*encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
    start = 0
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
    key = lambda x: (x[0] is not None, x[0], x[1])
    assert sorted(((r.doc_id, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in got), key=key) == sorted(rows, key=key)


def test_damage_is_found(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "tokens")
    token_files.write_token_files(docs, folder)
    blocks = spark.read.schema(token_files.BLOCKS).parquet(f"{folder}/blocks")
    broken = blocks.withColumn("payload", F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(b"\x01")))
    other = str(tmp_path / "broken")
    broken.write.parquet(f"{other}/blocks")
    spark.read.parquet(f"{folder}/frequencies").write.parquet(f"{other}/frequencies")
    with pytest.raises(Exception, match="damaged bytes"):
        token_files.read_token_files(spark, other).collect()


def test_no_token_files(spark, tmp_path):
    folder = str(tmp_path / "none")
    token_files.write_token_files(nothing(spark), folder)
    assert token_files.read_token_files(spark, folder).count() == 0


def plain_counts(text, rule):
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    section = [i for i, x in enumerate(lines) for _ in x]
    counts = [0] * len(lines)
    crossing = [0] * len(lines)
    found = encoder(attribution.TOKENIZER, True).tokenizer.encode(text, add_special_tokens=False)
    for begin, end in found.offsets:
        own = section[begin:end]
        best = max(set(own), key=lambda s: (own.count(s), -s))
        owner = {"first": own[0], "last": own[-1], "majority": best}[rule]
        counts[owner] += 1
        crossing[owner] += len(set(own)) > 1
    return [(i, len(x), c, k, len(found.ids)) for i, (x, c, k) in enumerate(zip(lines, counts, crossing, strict=True))]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_section_counts(spark, docs, rule):
    random.seed(3)
    texts = TEXTS + ["".join(random.choice("a\n \n.x1") for _ in range(60)) for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = attribution.section_token_counts(table, rule).orderBy("doc_id", "section").collect()
    want = [(i, *row) for i, t in enumerate(texts) for row in plain_counts(t or "", rule)]
    assert [(r.doc_id, r.section, r.end - r.begin, r.n_tokens, r.n_crossing, r.doc_tokens) for r in got] == want


def test_section_counts_of_nothing(spark):
    assert attribution.section_token_counts(nothing(spark)).count() == 0
    with pytest.raises(ValueError, match="rule"):
        attribution.section_token_counts(nothing(spark), "some")
