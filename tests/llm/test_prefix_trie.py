"""The conversation trie against one built member by member."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from linkloom.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string, n_leaves int, Depth string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path) == d))
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not children[p]
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, end in m if end))
        parent = min(members[p[:-1]])[0] if p else None
        out.add((min(m)[0], len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(seed, n=150):
    random.seed(seed)
    rows = []
    for c in random.sample(range(400), n):
        first = random.choice(["Hello  there", "Hello  there", None, "", "hi"])
        for t in range(random.randint(1, 7)):
            rows.append((c, t, random.choice(["user", "user", None]), random.choice([first, "a b", "a", "日本 x\ty"])))
    same = [(c, t, "user", f"turn {t} of all") for c in range(1000, 1120) for t in range(5)]
    odd = [(7, None, "user", "null turn"), (7, 0, "x", "tie"), (7, 0, "x", "tie"), (None, 1, "user", "lost"), (5_000_000, 1, "u", "t " * 40_000)]
    deep = [(c, t, "user", str(t)) for c in (2001, 2002) for t in range(300)]
    return rows + same + odd + deep


@pytest.mark.parametrize("shards", [1, 7, 60])
def test_against_a_plain_trie(spark, monkeypatch, shards):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rows = rows_of(shards)
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in prefix_trie.conversation_trie(turns).select(NAMES).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain(rows)
    assert len(got) == len(set(got)) == len(want)
    assert set(got) == want


def test_hot_conversation_is_dealt_over_shards(spark):
    """Equal conversations are split by number; their nodes come from the skeleton's partial sums."""
    paths = spark.range(1, 4001).select(
        F.col("id").alias("conv_id"), F.expr("array(struct(unhex('01') AS digest, 2L AS words), struct(unhex('02') AS digest, 3L AS words)) AS turns")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in prefix_trie.trie(paths).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ends = hashlib.sha256(",".join(map(str, range(1, 4001))).encode()).hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    assert got == {
        (1, 0, None, 4000, 1, 1, 3999 * 5, none), (1, 1, 1, 4000, 1, 1, 3999 * 5, none), (1, 2, 1, 4000, 0, 1, 3999 * 3, ends),
    }


def test_turnless_and_empty(spark):
    # crc32("9") % 4 is not 0 and conversation 0 is absent: nothing is left of a single turn
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    one = spark.createDataFrame([(c, 1, "user", "gone", 1, "x")], KIND)
    ends = hashlib.sha256(str(c).encode()).hexdigest()
    assert [tuple(r) for r in prefix_trie.conversation_trie(one).collect()] == [(c, 0, None, 1, 0, 1, 0, ends)]
    assert prefix_trie.conversation_trie(one.limit(0)).collect() == []
    assert prefix_trie.conversation_trie(one.withColumn("conv_id", F.lit(None).cast("long"))).collect() == []
