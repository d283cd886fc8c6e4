"""SentencePiece ids and texts against the library."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import pieces

TEXTS = [
    "", None, " ", "a", "  a  b ", "\n", "a\n\n b\t c", "ﬁ Ａ é é", "x\x00y", "▁a ▁", "<s></s><unk><0x41>", "😀日本﻿",
    "word " * 4000, "x" * 20_000, "▁" * 300, "Same text.", "Same text.",
]


def by_library(text):
    library = pieces.model().library
    ids = library.encode(text or "")
    digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return ids, (len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ▁\n\ttheing é😀日\x00ﬁ\x85<0x>'.,", max_size=90))
def test_ids_of_whole_texts(text):
    used = pieces.model()
    ids, counts = used.encode([text, "x", text, ""])
    want = by_library(text)[0]
    n = len(want)
    assert counts.tolist()[::2] == [n, n] and counts[3] == 0
    assert ids[:n].tolist() == ids[len(ids) - n :].tolist() == want
    assert used.merged("▁" + text.replace(" ", "▁")) == (want if text else [used.pieces["▁"][1]])
    assert used.checked_decode(ids, counts) == [used.library.decode(want), "x", used.library.decode(want), ""]


def test_any_ids_decode_as_in_the_library():
    used = pieces.model()
    random.seed(3)
    import numpy as np

    lists = [[random.choice([random.randrange(32_000), random.randrange(259)]) for _ in range(9)] for _ in range(500)]
    lists = [[i for i in ids if i != 0] for ids in lists] + [[], [29871, 29871], [259]]
    counts = np.array(list(map(len, lists)))
    got = used.decode(np.array([i for ids in lists for i in ids]), counts)
    assert got == used.library.decode(lists)


def test_words_forgotten_and_known(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 3)
    used = pieces.PieceModel()
    for text in ("one two three four five", "six seven one", "one two " + "y" * 100, "one " + "y" * 100):
        for _ in range(2):
            ids, _ = used.encode([text])
            assert ids.tolist() == by_library(text)[0]


def test_a_wrong_id_is_told(monkeypatch):
    used = pieces.PieceModel()
    right = used.merged_all
    monkeypatch.setattr(used, "merged_all", lambda words: (right(words)[0] + 1, right(words)[1]))
    with pytest.raises(ValueError, match="library"):
        used.encode(["hello there"])


def test_rows(spark):
    rows = [(i, t, 7, "n") for i, t in enumerate(TEXTS)] + [(3, "again", 7, "n"), (None, "no id", 7, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int, ids string").repartition(3)
    got = {tuple(r) for r in pieces.encoded(docs).collect()}
    assert got == {(i, *by_library(t)[1]) for i, t, *_ in rows}
    full = pieces.encoded(docs, with_ids=True).collect()
    assert len(full) == len(rows)
    assert sorted(r.ids for r in full) == sorted(by_library(t)[0] for _, t, *_ in rows)
    library = pieces.model().library
    assert sorted(r.decoded for r in full) == sorted(library.decode(by_library(t)[0]) for _, t, *_ in rows)
    assert pieces.encoded(docs.limit(0)).collect() == []
