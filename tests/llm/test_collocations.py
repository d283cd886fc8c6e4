"""Collocations against a plain count of all phrases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from linkloom.llm import collocations

KIND = "lang string, text string, PHRASE int, f string"


def plain(rows, least, covered, most):
    """Every phrase of every piece counted one by one."""
    counts, n = collections.Counter(), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                counts.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    found = collections.defaultdict(list)
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    for (lang, *words), a in candidates.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        longer = [f for p, f in candidates.items() if len(p) == 4 and len(words) == 2 and p[0] == lang and tuple(words) in (p[1:3], p[2:4])]
        if any(100 * f >= covered * a for f in longer):
            continue
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, ranked in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:most], 1)
    }


def rows_of(seed, n=240):
    random.seed(seed)
    words = ["the", "The", "of", "new", "york", "é", "日本", "x\x00y", "a", "b", "c", "longer-than-eight-letters", "ünïcode"]
    common = "new york, of the people. by the people for the people"
    rows = []
    for i in range(n):
        text = "".join(random.choice(words) + random.choice([" ", " ", "  ", "\t", ", ", "\n", ".", " ! "]) for _ in range(random.randint(0, 60)))
        rows.append((random.choice(["en", "de", None, ""]), text + (common if i % 3 == 0 else "")))
    return rows + [("en", None), ("en", ""), ("en", " ., "), ("en", "one"), ("fr", "spam " * 5000), ("fr", "only here")]


@pytest.mark.parametrize("seed,least,covered,most", [(1, 10, 50, 2000), (2, 3, 80, 7)])
def test_against_a_plain_count(spark, seed, least, covered, most):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], KIND).repartition(5)
    got = collocations.collocations(docs, least, covered, most)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.select(names).collect()} == plain(rows, least, covered, most)


def test_hot_parts_and_small_filters(spark, monkeypatch):
    """Nothing hot, everything hot, and filters of a few bits give the same rows."""
    rows = rows_of(3)
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], KIND)
    want = plain(rows, 5, 50, 50)
    for share in (1, 10**9):
        monkeypatch.setattr(collocations, "HOT_SHARE", share)
        assert {tuple(r) for r in collocations.collocations(docs, 5, 50, 50).collect()} == want
    full = collocations.bloom_filter
    monkeypatch.setattr(collocations, "bloom_filter", lambda phrases, size: full(phrases, size, 1024))
    assert {tuple(r) for r in collocations.collocations(docs, 5, 50, 50).collect()} == want


def test_scores_beyond_64_bits(spark):
    counted = spark.createDataFrame([("en", "a b", 5 * 10**12, 9 * 10**12, 8 * 10**12)], "lang string, phrase string, a long, l long, r long")
    weight = "cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)) * cast(1000000 AS decimal(7,0))"
    got = counted.selectExpr(f"({weight}) DIV (cast(l AS decimal(15,0)) * cast(r AS decimal(15,0)))").first()[0]
    assert got == 10**6 * (5 * 10**12) ** 2 // (72 * 10**24)


def test_no_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert collocations.collocations(none).collect() == []
    few = spark.createDataFrame([("en", "a b", 1, "f"), (None, None, 1, "f")], KIND)
    assert collocations.collocations(few).collect() == []


def test_parse_is_prefix_free_and_covers_every_word():
    texts = [t or "" for _, t in rows_of(4)]
    owner, chunks, last = collocations.chunks_of(pa.array(texts), span=3)
    chunks = chunks.to_pylist()
    closed = sorted(c for c, end in zip(chunks, last.tolist()) if not end)
    assert not any(b != a and b.startswith(a + " ") for a, b in zip(closed, closed[1:]))
    for number, text in enumerate(texts):
        own = [c for c, o in zip(chunks, owner.tolist()) if o == number]
        words = [w for c in own[:-1] for w in re.split("[ \n]", c)[:-2]] + (re.split("[ \n]", own[-1]) if own else [])
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        assert words == re.findall(r"[^ \t.,;:!?\n\x0b\x0c\r]+", lower)
    # equal passages give equal chunks wherever they stand
    passage = "one two three four five six seven eight nine ten " * 20
    _, chunks, last = collocations.chunks_of(pa.array(["alpha beta " + passage, "gamma, " + passage]), span=3)
    assert len(set(chunks.to_pylist())) <= len(chunks) // 2 + 4
    assert np.count_nonzero(last) == 2
