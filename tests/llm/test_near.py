"""Similarity join, components, Merkle fingerprints and decontamination against plain versions."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from linkloom.llm import decontamination, merkle, partenum
from linkloom.llm.components import components
from linkloom.llm.shingles import shingle_sets
from linkloom.session import BATCH_BYTES, TEXT_BYTES, arrow_batches

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, words):
    found = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def varied(rng, base, share):
    return " ".join(rng.choice("pqrstuv") * 3 + str(rng.randrange(999)) if rng.random() < share else w for w in base.split(" "))


def corpus(seed=1):
    """Copies, near copies, chains of near copies, a common passage, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(40))
    texts = [None, "", "  \n\t", "One", "one", "a b c d", "A B\tc D", "a b c d e", "É é", "é é"]
    for n in (3, 6, 9, 12, 20, 40, 90, 300, 700):
        for _ in range(3):
            base = " ".join(word() for _ in range(n))
            texts += [base, base.upper()] + [varied(rng, base, s) for s in (0.003, 0.01, 0.02, 0.03, 0.05)]
            chain = base
            for _ in range(4):
                chain = varied(rng, chain, 0.015)
                texts.append(chain)
        for _ in range(8):
            texts.append(passage + " " + " ".join(word() for _ in range(n)))
    base = " ".join(word() for _ in range(120))
    texts += [varied(rng, base, 0.004) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


def plain_components(rows, words, percent):
    sets = {i: plain_set(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_similarity_classes(spark, words, percent):
    rows = corpus(words)
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, component string")
    got = partenum.near_duplicates(table.repartition(5), words, percent).collect()
    assert sorted(map(tuple, got)) == plain_components(rows, words, percent)


@pytest.mark.parametrize("most", [2, 6])
def test_levels_of_signatures(spark, monkeypatch, most):
    """With every group too large to be compared at once, the next levels find the same links."""
    monkeypatch.setattr(partenum, "GROUP", 2)
    monkeypatch.setattr(partenum, "MOST", most)
    monkeypatch.setattr(partenum, "FILTER_BITS", 1 << 12)
    monkeypatch.setattr(partenum, "BROADCAST_IDS", 3 if most == 2 else 200_000)
    monkeypatch.setattr(partenum, "HOT_SHARE", 10**9 if most == 2 else 1)
    rows = corpus(9)[::3]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = partenum.near_duplicates(table, 4, 85).collect()
    assert sorted(map(tuple, got)) == plain_components(rows, 4, 85)



def test_large_sets_are_ruled_out_before_their_texts_are_read(spark):
    """Of large sets that have half in common counts in cells say too little; parities tell, and lose no link."""
    rng = np.random.default_rng(3)
    sets, pairs = {}, {"apart": [], "linked": []}
    for n in (1, 3, 40, 700, 6_000, 17_000):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets[len(sets)] = np.unique(base)
        own = len(sets) - 1
        for share, kind in ((0.5, "apart"), (0.9, "linked"), (1.25, "linked")):
            if share < 1:
                new = rng.integers(0, 2**64, n - round(n * share), dtype=np.uint64)
                other = np.unique(np.concatenate([base[: round(n * share)], new]))
            else:
                other = np.unique(np.concatenate([base, rng.integers(0, 2**64, n // 5, dtype=np.uint64)]))
            common = len(np.intersect1d(sets[own], other))
            sets[len(sets)] = other
            if (100 * common >= 80 * (n + len(other) - common)) == (kind == "linked"):
                pairs[kind].append((own, len(sets) - 1))
    fine = {i: partenum.sketch(s, partenum.FINE).view(np.uint8).astype(np.int16) for i, s in sets.items()}
    unsure = [
        (a, b) for a, b in pairs["apart"]
        if partenum._may_link(fine[a], np.array(len(sets[a])), fine[b], np.array(len(sets[b])), 80)
    ]
    assert any(len(sets[a]) > 5_000 for a, _ in unsure)
    rows = [(i, len(s), partenum.odd_sketch(s)) for i, s in sets.items()]
    table = spark.createDataFrame(rows, "doc_id long, n_shingles long, odd binary")
    every = spark.createDataFrame(unsure + pairs["linked"], "a long, b long")
    left = {(r.a, r.b) for r in partenum.close_pairs(every, table, 80).collect()}
    assert left >= set(pairs["linked"]) and len(pairs["linked"]) >= 8
    assert not [p for p in left & set(unsure) if len(sets[p[0]]) > 500]


def test_python_gets_whole_texts_by_bytes(spark):
    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes])})

    texts = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('x', 100000) AS text")
    before = spark.conf.get(BATCH_BYTES)
    with arrow_batches(spark, partenum.BATCH_ROWS):
        most = texts.mapInArrow(told, "bytes long").agg({"bytes": "max"}).first()[0]
    assert most < 1.2 * TEXT_BYTES
    assert spark.conf.get(BATCH_BYTES) == before


@pytest.mark.parametrize("level", range(partenum.LEVELS))
@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_share_a_signature(level, percent):
    rng = np.random.default_rng(level)
    starts = partenum.band_starts(percent, 20_000)
    for size in [1, 2, 3, 5, 6, 7, 9, 12, 14, 17, 20, 25, 33, 60, 130, 251, 500, 1200, 3000]:
        for _ in range(12 if size < 500 else 3):
            members = rng.integers(0, 2**63, size).astype(np.uint64)
            gone = int(rng.integers(0, size * (100 - percent) // 100 + 1))
            other = members[gone:]
            new = 0
            while 100 * (size - gone) >= percent * (size + new + 1):
                new += 1
            new = int(rng.integers(new // 2, new + 1))
            other = np.unique(np.concatenate([other, rng.integers(0, 2**63, new).astype(np.uint64)]))
            common = len(np.intersect1d(members, other))
            assert 100 * common >= percent * (size + len(other) - common)
            a, b = (set(partenum.signatures(np.unique(s), percent, level, starts).tolist()) for s in (members, other))
            assert a & b


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(1)
    for size in (1, 4, 30, 400, 20_000):
        for percent in (60, 85):
            members = rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2)
            gone = size * (100 - percent) // 100
            for other in (members[gone:], np.concatenate([members[gone // 2 :], rng.integers(0, 2**63, gone // 3).astype(np.uint64)])):
                common = len(np.intersect1d(members, other))
                if 100 * common >= percent * (size + len(other) - common):
                    cells = [partenum.sketch(s).view(np.uint8).astype(np.int16) for s in (members, other)]
                    assert partenum._may_link(cells[0], np.array(size), cells[1], np.array(len(other)), percent)
                    cells = [partenum.sketch(s, partenum.FINE).view(np.uint8).astype(np.int16) for s in (members, other)]
                    assert partenum._may_link(cells[0], np.array(size), cells[1], np.array(len(other)), percent)


def test_every_pair_has_one_turn(spark):
    for n in (1, 2, 8, 9, 40, 1024, 5000):
        own = partenum.turns(n)
        assert own[0][0] == 0 and own[-1][1] == 1 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        assert len(own) <= len(partenum.turns(2 * partenum.GROUP)) or n > 2 * partenum.GROUP
    empty = {c: 0 for c in partenum.FINE_CELLS}
    rows = [{"signature": 1, "node": i, "component": i // 2, "size": 3} | empty for i in range(120)]
    kinds = ", ".join(f"{c} long" for c in ("signature", "node", "component", "size", *partenum.FINE_CELLS))
    rows = spark.createDataFrame([tuple(r.values()) for r in rows], kinds)
    met = [[(r.a, r.b) for r in partenum.group_pairs(rows, 80, turn).collect()] for turn in range(6)]
    assert sorted(sum(met, [])) == [(a, b) for a in range(120) for b in range(a + 1, 120) if a // 2 != b // 2]
    assert 0 < len(met[0]) < 120 * 8


def test_groups_are_in_the_rounds_in_which_they_have_pairs():
    for n in (1, 2, 8, 9, 40, 41, 168, 169, 1024, 5000):
        own = len(partenum.turns(n))
        assert [t for t in range(8) if n > partenum.partners_before(t)] == list(range(own))


@pytest.mark.parametrize("level", range(partenum.LEVELS))
def test_sets_can_do_without_as_many_signatures_as_they_have_room_for(level):
    """Whatever groups a set leaves, one more signature is shared with each similar set."""
    rng = np.random.default_rng(level)
    starts = partenum.band_starts(80, 20_000)
    rooms = []
    for size in [1, 3, 6, 12, 17, 33, 60, 130, 251, 500, 1200, 3000]:
        for _ in range(6 if size < 500 else 2):
            members = rng.integers(0, 2**63, size).astype(np.uint64)
            gone = int(rng.integers(0, size // 5 + 1))
            other = members[gone:]
            (a, room_a), (b, room_b) = (partenum.signed(np.unique(s), 80, level, starts) for s in (members, other))
            shared = set(a.tolist()) & set(b.tolist())
            most = max(sum(s % 2 == band for s in shared) for band in (0, 1))
            assert most > max(room_a, room_b)
            rooms.append(room_a)
    assert max(rooms) > 8


def test_nodes_leave_crowded_groups_that_they_have_room_for(spark, monkeypatch):
    monkeypatch.setattr(partenum, "CROWD", 3)
    room = {1: 2, 2: 1, 3: 1, 4: 0, 5: 0, 6: 9}
    groups = {10: ([1, 2, 3, 4, 5, 6], 2, 1), 12: ([1, 3, 4, 5], 1, 1), 14: ([1, 2, 4], 1, 0)}  # nodes, weight, odd
    rows = [(s, n, room[n], min(g), len(g), weight, odd) for s, (g, weight, odd) in groups.items() for n in g]
    table = spark.createDataFrame(rows, "signature long, node long, room int, pivot long, n_nodes long, weight long, odd long")
    left = {}
    for r in partenum._uncrowded(table).collect():
        left.setdefault((r.signature, r.n_nodes), []).append(r.node)
    assert {k: sorted(v) for k, v in left.items()} == {(14, 3): [1, 2, 4], (10, 3): [3, 4, 5], (12, 3): [3, 4, 5]}


def test_a_common_passage_brings_few_pairs_together(spark, monkeypatch):
    """Texts that share a passage and no more are not compared pair by pair, and no link is lost."""
    monkeypatch.setattr(partenum, "CROWD", 4)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = [passage + " " + " ".join(word() for _ in range(400)) for _ in range(60)]
    texts += [varied(rng, t, 0.01) for t in texts[::6]]
    rows = list(enumerate(texts, 1))
    named, grouped = [], partenum.group_pairs

    def watched(rows, percent, turn):
        named.append(rows.groupBy("signature").count().selectExpr("sum(count * (count - 1) / 2)").first()[0])
        return grouped(rows, percent, turn)

    monkeypatch.setattr(partenum, "group_pairs", watched)
    got = partenum.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted(map(tuple, got)) == plain_components(rows, 4, 85)
    assert sum(named) < 60 * 59 / 4


@pytest.mark.parametrize("crowd", [1, 3])
def test_crowded_groups_lose_no_link(spark, monkeypatch, crowd):
    monkeypatch.setattr(partenum, "CROWD", crowd)
    rows = corpus(4)
    got = partenum.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(map(tuple, got)) == plain_components(rows, 5, 80)


def test_blocks_bring_every_pair_together(spark, monkeypatch):
    monkeypatch.setattr(partenum, "GROUP", 4)
    rows = spark.range(19).selectExpr("7L AS signature", "id AS node", "19L AS n_nodes")
    met = {}
    for r in partenum.in_blocks(rows).collect():
        met.setdefault(r.signature, set()).add(r.node)
    assert all(any({a, b} <= g for g in met.values()) for a in range(19) for b in range(19))


def test_odd_rows_of_the_join(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (7, "u v w x y z"), (9, "A b c d e f"), (9, "A b c d e f"), (None, "a b c d e f"), (None, None)]
    got = partenum.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted(map(str, got)) == sorted(
        f"Row(doc_id={i}, n_shingles={n}, component_id={c})" for i, n, c in
        [(1, 3, 1), (1, 3, 1), (7, 3, 1), (9, 3, 1), (9, 3, 1), (None, 3, None), (None, 0, None)]
    )
    assert partenum.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 4, 85).count() == 0
    with pytest.raises(ValueError, match="percent"):
        partenum.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 4, 20)


def test_shingles_are_those_of_the_words():
    texts = ["a b c d e", " a  b c d e ", "x a b c d e", "", "ab c", "a bc", "A B C D E", "e d c b a", "a b c d e a b c d e", "\x1fa b", "é a b c"]
    sets = shingle_sets(pa.array(texts), 4)
    seen = {}
    for text, found in zip(texts, sets, strict=True):
        plain = plain_set(text, 4)
        assert len(plain) == len(found)
        seen[frozenset(plain)] = seen.get(frozenset(plain), frozenset(found.tolist()))
        assert seen[frozenset(plain)] == frozenset(found.tolist())
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(900, i) for i in range(700, 760)]
    links += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)] + [(3, 3)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {n: n for a, b in links if a != b for n in (a, b)}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Merkle fingerprints ---------------------------------------------------------------------------


def merkle_rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randint(1, 30))) + rng.choice([".", "!", ""])
    texts = ["", None, "a", "ab", "日本語テスト", "same", "same", "x" * 1000, "\n\n\n", "😀" * 70 + ". b"]
    texts += ["\n".join(line() for _ in range(rng.randint(1, 40))) for _ in range(25)]
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_compared(spark):
    rows = merkle_rows()
    table = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(4)
    got = {r.doc_id: r for r in merkle.compared(table).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    prints = {r.fingerprint for r in got.values()}
    assert len(prints) == len({t or "" for _, t in rows})
    for (i, t), (j, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u, r = t or "", u or "", got[i]
        third = len(t) // 3
        edited = t[: len(t) - third] + u[:third]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
        assert (r.near_next == 1.0) == (t == u)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if len(t) > 800 and t != "x" * 1000 and len(u) >= third:
            assert 0.5 < r.near_edited < 0.85 and r.near_next < 0.4


def plain_fingerprint(pieces):
    """The tree by plain loops over pieces."""
    sha = lambda s, n=16: hashlib.sha256(s.encode()).hexdigest()[:n]
    paragraphs, sections = [[]], [[]]
    for piece in pieces:
        leaf = xxhash.xxh64(piece.encode(), seed=42).intdigest() & ~1 | piece.endswith("\n")
        paragraphs[-1].append(f"{leaf:016x}")
        if piece.endswith("\n"):
            paragraphs.append([])
    if len(paragraphs) > 1 and not paragraphs[-1]:
        paragraphs.pop()
    for leaves in paragraphs:
        own = sha(".".join(leaves))
        sections[-1].append((own, ".".join(x[:8] for x in leaves)))
        if own[-1] in merkle.SECTION_ENDS:
            sections.append([])
    if len(sections) > 1 and not sections[-1]:
        sections.pop()
    named = [(sha(",".join(h for h, _ in s)), ",".join(f"{h}>{x}" for h, x in s)) for s in sections]
    return sha("".join(h for h, _ in named), 32) + ":" + "|".join(f"{h}={x}" for h, x in named)


def test_pieces_join_to_the_text(spark):
    rows = [t for _, t in merkle_rows() if t]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in rows], "text string")
    for r in df.select("text", merkle.pieces(F.col("text")).alias("p"), merkle.fingerprint(F.col("text")).alias("f")).collect():
        assert "".join(r.p) == r.text
        assert r.f == plain_fingerprint(r.p)
    assert spark.range(1).select(merkle.fingerprint(F.lit(""))).first()[0] == plain_fingerprint([])


def test_roots_tell_short_texts_apart(spark):
    from pyspark.sql import functions as F

    texts = spark.range(400_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("text"))
    assert texts.select(merkle.root_of(merkle.fingerprint(F.col("text"))).alias("r")).distinct().count() == 400_000


def test_likeness_of_neighbours_by_plain_sets(spark):
    """near_edited and near_next are the Dice share of the written leaves."""
    rows = merkle_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in merkle.compared(table).collect()}
    leaves = lambda f: set(re.findall(r"(?<=[>.])[0-9a-f]{8}", f))
    dice = lambda a, b: 1.0 if a == b else 2 * len(a & b) / (len(a) + len(b))
    order = sorted(got, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        a, b, c = (leaves(f) for f in (got[i].fingerprint, got[i].edited_fingerprint, got[j].fingerprint))
        assert got[i].near_edited == pytest.approx(dice(a, b)) and got[i].near_next == pytest.approx(dice(a, c))


def test_edits_are_located(spark):
    from pyspark.sql import functions as F

    lines = [f"line {i} of the text, with two pieces" for i in range(60)]
    other = list(lines)
    other[41] = "line 41 of the text, but changed"
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    a, b = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    row = df.select(merkle.edits(a, b).alias("e"), b.alias("b"), merkle.edits(a, a).alias("none")).first()
    assert row.none == []
    sections = [s.split("=")[1].split(",") for s in row.b.split(":")[1].split("|")]
    (section,) = row.e
    assert [sum(map(len, sections[: section.section])) + p.paragraph for p in section.paragraphs] == [41]
    assert section.paragraphs[0].leaves == [1]


def test_odd_rows_of_fingerprints(spark):
    schema = "doc_id long, text string"
    assert merkle.compared(spark.createDataFrame([], schema)).count() == 0
    alone = merkle.compared(spark.createDataFrame([(4, "abcdef")], schema)).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = [(1, "aaa"), (1, "aaa"), (1, "bbb"), (None, "ccc"), (2, "ddd")]
    got = sorted((str(r.doc_id), r.edited_sha256) for r in merkle.compared(spark.createDataFrame(rows, schema)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == 5
    assert got[:3] == sorted([("1", sha("aac")), ("1", sha("aac")), ("1", sha("bbc"))])
    assert got[4] == ("None", sha("ccd"))


def test_ids_with_several_texts(spark):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    near = lambda name, n=60: text(name, n) + " more"
    rows = [(7, text("a")), (7, text("b", 200)), (21, near("a")), (22, near("b", 200))]  # the smallest of all its classes
    rows += [(30, text("c")), (31, text("d")), (32, text("e")), (39, text("c")), (39, text("d")), (39, text("e"))]  # three classes
    rows += [(40, text("f")), (49, text("f")), (49, text("g")), (50, near("g"))]  # g stands under the larger id only
    rows += [(60, text("h")), (61, text("i"))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in partenum.near_duplicates(table, 4, 85).collect()}
    want = {7: (7, 21, 22), 30: (30, 31, 32, 39), 40: (40, 49, 50), 60: (60,), 61: (61,)}
    assert got == {(i, c) for c, ids in want.items() for i in ids}


# Decontamination -------------------------------------------------------------------------------


def plain_overlaps(docs, items):
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    out = set()
    for i, t in docs:
        w = words(t)
        for j, u in items:
            v = words(u)
            for shift in range(-len(v) + 1, len(w)):
                equal = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(v)]
                n = max(len(v) - decontamination.WINDOW + 1, 1)
                densest = max(sum(equal[k : k + decontamination.WINDOW]) for k in range(n)) if v else 0
                if v and (sum(equal) >= decontamination.LEAST_SHARE * len(v) or densest >= decontamination.LEAST_IN_WINDOW):
                    out.add((i, j))
    return out


def test_overlaps(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    items = [(j, " ".join(word() for _ in range(rng.randint(14, 50)))) for j in range(12)]
    items += [(90, items[0][1]), (91, None), (92, "")]
    docs = [(0, None), (1, ""), (2, "short text")]
    for i in range(60):
        j, text = items[rng.randrange(12)]
        body = text.split(" ")
        for _ in range(i % 5 * len(body) // 30):  # replaced words, up to an eighth
            body[rng.randrange(len(body))] = word()
        if i % 7 == 0:
            body = [word() for _ in body]
        front, back = ([word() for _ in range(rng.randint(0, 80))] for _ in range(2))
        docs.append((10 + i, " ".join(front) + ". " + ", ".join(body).upper() + " " + " ".join(back)))
    docs.append((70, docs[20][1] + " " + docs[30][1]))
    docs.append((71, " ".join(items[3][1].split(" ")[:16])))
    table = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_overlaps(docs, items)
    got = decontamination.overlaps(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = decontamination.without_contaminated(table, bench)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 1)
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(table, bench).collect()} == want


def fewest_replaced(masks, words):
    """The fewest words to replace so that no mask fits anywhere, by all strings of equal and replaced words."""
    span = max(map(len, masks))
    best = {"": 0}
    for _ in range(words):
        after = {}
        for last, n in best.items():
            for bit in "01":
                now = last + bit
                if any(len(m) <= len(now) and all(x == "0" or y == "1" for x, y in zip(m, now[-len(m) :], strict=True)) for m in masks):
                    continue
                after[now[1 - span :]] = min(after.get(now[1 - span :], words), n + (bit == "0"))
        best = after
    return min(best.values())


def test_masks_fit_whatever_the_rule_accepts():
    (least, masks), (_, short) = decontamination.MASKS[:2]
    # lengths from least to twice as many add up to any greater length, and so do the words to replace
    assert all(10 * fewest_replaced(masks, n) > 3 * n for n in range(least, 2 * least))
    assert all(10 * fewest_replaced(short, n) > 3 * n for n in range(5, least))
    assert fewest_replaced(masks, decontamination.WINDOW) > decontamination.WINDOW - decontamination.LEAST_IN_WINDOW


def test_overlaps_with_many_replaced_words(spark):
    rng = random.Random(5)
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in (7, 10, 15, 16, 18, 20, 38, 59)]
    docs = []
    for n, text in items:
        for start in range(4):  # every fourth word
            body = ["other" if i % 4 == start else w for i, w in enumerate(text.split(" "))]
            docs.append((len(docs), "front " * start + " ".join(body) + " back" * 9))
        for _ in range(30):  # anywhere, as many as the rule allows
            body = text.split(" ")
            for i in rng.sample(range(n), 3 * n // 10):
                body[i] = "other"
            docs.append((len(docs), "front " * 5 + " ".join(body) + " back" * 9))
    want = plain_overlaps(docs, items)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = decontamination.overlaps(table, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) >= 30 * len(items)


def test_short_benchmark_texts(spark):
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(1, 13)]
    docs = [(n, f"front {t} back") for n, t in items] + [(20 + n, t) for n, t in items]
    docs += [(40 + 10 * n + i, "a " + t.replace(f"x{i}", "other", 1) + " b") for n, t in items for i in range(n)]
    want = plain_overlaps(docs, items)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = decontamination.overlaps(table, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want >= {(n, n) for n, _ in items}


def test_overlaps_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.overlaps(docs, none).count() == 0
    assert decontamination.without_contaminated(docs, none).count() == 1
    assert decontamination.overlaps(docs.limit(0), spark.createDataFrame([(1, "a b c")], none.schema)).count() == 0


def test_short_items_and_repeated_words_in_long_texts(spark):
    """One common word as a benchmark text, and a text of one word repeated: the time is that of the text."""
    items = [(1, "the"), (2, "the end"), (3, "spam " * 40), (4, "v1 v2 v3 v4"), (5, "one two three")]
    docs = [
        (1, " ".join("the" if i % 3 == 0 else f"w{i}" for i in range(100_000))), (2, "spam " * 20_000), (3, "at the end"),
        (4, "v1 v2 xx v4 v1 v2 v3 v4"), (5, "one two"), (6, "a one two three one two three"), (1, "other the end"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    started = time.time()
    got = {(r.doc_id, r.item_id): (r.doc_word, r.matched, r.densest) for r in decontamination.overlaps(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert time.time() - started < 100
    assert got == {
        (1, 1): (0, 1, 1), (3, 1): (1, 1, 1), (1, 2): (1, 2, 2), (3, 2): (1, 2, 2), (2, 3): (0, 40, 16), (4, 4): (4, 4, 4), (6, 5): (1, 3, 3),
    }
    small = [(i, t) for i, t in docs if len(t) < 1000]
    assert {k for k in got if k not in ((1, 1), (2, 3))} == plain_overlaps(small, items) - {(1, 1)}
