"""Prefix trie of conversations by a splitter skeleton.

A conversation is the path of its turns' digests. Paths are sorted and dealt into shards by range, by
conversation number among equal paths, so that neither a common beginning nor a common conversation
fills one shard. The paths at the borders of shards, as far as both neighbours share them, make a
small trie, the skeleton, which every task gets: a node with members in two shards is on it. All other
nodes lie in one shard and are finished there in one pass over its sorted paths. Of skeleton nodes each
shard gives a partial aggregate; a reduction adds them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.numbering import with_dense_ids
from linkloom.session import stage

GROUP = 20  # conversation c begins as conversation c - c % GROUP
SHARES = 4  # with crc32(c) % SHARES of its turns
CHUNK_IDS = 16_384  # numbers of members handed on in one row
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_FOUND = f"kind string, {_NODE}, parent_conv_id long, node long, words long, ends string, shard long, part long"
_NAMES = [field.split()[0] for field in _FOUND.split(", ")]


def paths(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of (digest, words) in order, for every conversation.

    ``turns``: conv_id, turn, role, text. They are ranked over all conversations by ranges, so a long
    one is sorted by many tasks; its array has no texts, just some 30 bytes a turn.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ranked = with_dense_ids(rows, ["conv_id", "turn", "role", "text"], "place")
    whole = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    turn = F.struct(
        "place",
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    listed = ranked.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def rebuilt(own: DataFrame, group: int = GROUP, shares: int = SHARES) -> DataFrame:
    """Every conversation c of ``paths`` begins with the first h turns of c - c % ``group``, h being
    crc32(c) % ``shares``, and goes on with its own turns after its first h."""
    own = own.select(
        "*",
        (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shares).cast("int").alias("h"),
    )
    heads = own.where("conv_id = base").select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, max(shares - 1, 1)).alias("head")
    )
    given = F.expr("slice(coalesce(head, array()), 1, h)")
    rest = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return own.join(heads, "base", "left").select("conv_id", F.concat(given, rest).alias("turns"))


def _skeleton(ranged: DataFrame) -> dict[tuple[int, bytes], int]:
    """Numbers of the skeleton's nodes by their parent and last digest; the root is 0.

    One path for each border between shards reaches the driver, cut where the shards part.
    """
    row = F.struct("spot", "path")
    ends = ranged.groupBy("shard").agg(F.min(row)["path"].alias("head"), F.max(row)["path"].alias("tail"))
    before = F.lag("tail").over(Window.orderBy("shard"))
    borders = ends.select("head", before.alias("tail")).where("tail IS NOT NULL")
    parts = F.expr("array_position(zip_with(head, tail, (a, b) -> a <=> b), false)")
    shared = F.when(parts > 0, parts - 1).otherwise(F.size("head")).cast("int")
    nodes: dict[tuple[int, bytes], int] = {}
    for (path,) in borders.select(F.slice("head", F.lit(1), shared)).toLocalIterator():
        at = 0
        for digest in path:
            at = nodes.setdefault((at, bytes(digest)), len(nodes) + 1)
    return nodes


class _Open:
    """A node whose members are being read."""

    __slots__ = ("number", "words", "n", "least", "children", "leaves", "saved", "held", "digest", "ids", "part")

    def __init__(self, number: int | None, words: int) -> None:
        self.number, self.words = number, words  # number: on the skeleton
        self.n, self.least = 0, None
        self.children = self.leaves = self.saved = 0
        self.held: list[list] = []  # children that wait for the smallest member
        self.digest, self.ids, self.part = None, [], 0


class _Shard:
    """The nodes of one shard's sorted paths; finished rows are in ``out``."""

    def __init__(self, skeleton: dict[tuple[int, bytes], int], shard: int, out: list[tuple]) -> None:
        self.skeleton, self.shard, self.out = skeleton, shard, out
        self.open = [_Open(0, 0)]
        self.path: list[bytes] = []

    def add(self, conv_id: int, path: list[bytes], words: list[int]) -> None:
        common = 0
        for mine, last in zip(path, self.path):
            if mine != last:
                break
            common += 1
        self.close(common)
        for depth in range(common, len(path)):
            above = self.open[-1].number
            number = None if above is None else self.skeleton.get((above, path[depth]))
            self.open.append(_Open(number, words[depth]))
        self.path = path
        node = self.open[-1]
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if node.number is None:
            if node.digest is None:
                node.digest = hashlib.sha256(str(conv_id).encode())
            else:
                node.digest.update(f",{conv_id}".encode())
        else:
            node.ids.append(conv_id)
            if len(node.ids) >= CHUNK_IDS:
                self._hand_on(node)

    def _hand_on(self, node: _Open) -> None:
        if node.ids:
            ids = ",".join(map(str, node.ids))
            self.out.append(("ends", *[None] * 7, node.number, None, ids, self.shard, node.part))
            node.ids, node.part = [], node.part + 1

    def close(self, depth: int = -1) -> None:
        """Finish the open nodes below ``depth``."""
        while len(self.open) - 1 > depth:
            at = len(self.open) - 1
            node = self.open.pop()
            if not node.n:  # a root without members
                continue
            above = self.open[-1] if self.open else None
            if above:
                above.n += node.n
                above.least = node.least if above.least is None else min(above.least, node.least)
            if node.number is not None:
                row = (node.least, at, node.n, node.children, node.leaves, node.saved)
                self.out.append(("partial", *row, None, node.number, node.words, None, None, None))
                self._hand_on(node)
                continue
            leaves = node.leaves if node.children else 1
            saved = node.saved + (node.n - 1) * node.words
            ends = node.digest.hexdigest() if node.digest else _EMPTY
            for row in node.held:
                self.out.append((*row[:7], node.least, *row[8:]))
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            row = ("node", node.least, at, node.n, node.children, leaves, saved, None, above.number, None, ends, None, None)
            (above.held if above.number is None else self.out).append(row)


def _finished(ranged: DataFrame, skeleton) -> DataFrame:
    """Nodes, partial aggregates of skeleton nodes and lists of members of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if n in ("kind", "ends") else pa.int64()) for n in _NAMES])
        at, out = None, []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, schema.field(n).type) for n, c in enumerate(columns)], schema=schema
            )

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("shard", "conv_id", "path", "words")]
            for shard, conv_id, path, words in zip(*columns):
                if at is None or at.shard != shard:
                    if at:
                        at.close()
                    at = _Shard(skeleton.value, shard, out)
                at.add(conv_id, path, words)
                if len(out) > 20_000:
                    yield rows()
        if at:
            at.close()
        if out:
            yield rows()

    return ranged.select("shard", "conv_id", "path", "words").mapInArrow(run, _FOUND)


def _reduced(found: DataFrame, skeleton: dict[tuple[int, bytes], int]) -> list[list]:
    """The skeleton's nodes, of which the driver has the paths: partial aggregates added up, then from
    the deepest to the root what lies below each added to its parent."""
    sums = found.where("kind = 'partial'").groupBy("node").agg(
        F.min("conv_id"), F.first("depth"), *[F.sum(n) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words")
    )
    nodes = {row[0]: list(row) for row in sums.toLocalIterator()}
    parents = {number: parent for (parent, _), number in skeleton.items()}
    for number in sorted(nodes, key=lambda n: -nodes[n][2]):
        node = nodes[number]
        node[5] = node[5] if node[4] else 1
        node[6] += (node[3] - 1) * node[7]
        if number:
            above = nodes[parents[number]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return [[*node[:7], nodes[parents[n]][1] if n else None] for n, node in nodes.items()]


def _digests(parts: DataFrame) -> DataFrame:
    """node, ends_sha256 of members' numbers that come in parts, in order; a part is read at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = digest = None
        for batch in batches:
            for number, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if number != node and digest:
                    yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [digest.hexdigest()]})
                if number != node:
                    node, digest = number, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if digest:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [digest.hexdigest()]})

    ordered = parts.repartition("node").sortWithinPartitions("node", "shard", "part")
    return ordered.select("node", "ends").mapInArrow(run, "node long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conversations``: conv_id and turns, as ``paths`` and ``rebuilt`` give them.

    A row a node, that is a distinct sequence of the first ``depth`` turns (role and text) of some
    conversation, from the root (0): conv_id, its smallest member; depth; parent_conv_id, the parent's
    conv_id, null for the root; n_convs, its members; n_children; n_leaves, nodes without children in
    its subtree; saved_tokens, over its subtree (members - 1) times the words of a node's last text;
    ends_sha256, of the members that end there. A conversation without turns is a member of the root.
    No conversations, no rows. A path is one row and a shard holds one open node for each of its turns.
    """
    spark = conversations.sparkSession
    flat = conversations.select(
        "conv_id", F.transform("turns", lambda t: t["digest"]).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")
    )
    order = ["path", "conv_id"]
    spot = F.monotonically_increasing_id()
    ranged = flat.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", spot)
    ranged = stage(ranged.withColumn("shard", F.shiftright("spot", 33)))
    skeleton = _skeleton(ranged)
    shards = ranged.repartitionByRange("shard").sortWithinPartitions("shard", "spot")
    shared = spark.sparkContext.broadcast(skeleton)
    found = stage(_finished(shards, shared))
    shared.unpersist()

    kinds = f"node long, {_NODE}, parent_conv_id long"
    top = stage(spark.createDataFrame(_reduced(found, skeleton), kinds))
    ends = _digests(found.where("kind = 'ends'"))
    top_rows = top.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    parents = F.broadcast(top.select("node", F.col("conv_id").alias("top_conv_id")))  # as large as the skeleton
    below = found.where("kind = 'node'").join(parents, "node", "left")
    below = below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top_conv_id"))
    below = below.withColumnRenamed("ends", "ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return below.select(columns).unionByName(top_rows.select(columns))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """``trie`` of the ``rebuilt`` conversations of a table of turns (conv_id, turn, role, text).

    Turns stand in the order of turn, null first, those with one number by role and text. A null role
    or text is empty, repeated rows are turns of their own, rows with a null conv_id belong to no
    conversation. An empty table gives no rows; other columns are not looked at. Texts of any length
    are read once, for their digest and their words.
    """
    return trie(stage(rebuilt(paths(turns))))


def counterpart() -> str:
    """The same rows in SQL."""
    return rf"""
    WITH turns AS (
        SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
    ), convs AS (
        SELECT DISTINCT conv_id AS c, xor(list_reduce(
                   list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                   lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                       lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
               ), 4294967295::BIGINT) % {SHARES} AS h
        FROM turns
    ), mixed AS (
        SELECT c, p, role, text FROM convs JOIN turns ON conv_id = c - c % {GROUP} AND p <= h
        UNION ALL
        SELECT c, p + 10, role, text FROM convs JOIN turns ON conv_id = c AND p > h
    ), numbered AS (
        SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, sha256(length(role) || ':' || role || text) AS digest,
               len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
        FROM mixed
    ), steps AS (
        SELECT c, d, words, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d) AS path, count(*) OVER (PARTITION BY c) AS n FROM numbered
        UNION ALL
        SELECT c, 0, 0, '', (SELECT count(*) FROM mixed m WHERE m.c = convs.c) FROM convs
    ), nodes AS (
        SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words,
               sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
        FROM steps GROUP BY path, d
    ), counted AS (
        SELECT x.*, p.conv_id AS parent_conv_id,
               (SELECT count(*) FROM nodes y WHERE y.d = x.d + 1 AND y.path[1 : 64 * x.d] = x.path) AS n_children
        FROM nodes x LEFT JOIN nodes p ON p.d = x.d - 1 AND p.path = x.path[1 : 64 * (x.d - 1)]
    ), below AS (
        SELECT s.path, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved_tokens
        FROM counted v JOIN steps s ON s.c = v.conv_id AND s.d <= v.d GROUP BY s.path
    )
    SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
           saved_tokens::BIGINT AS saved_tokens, ends_sha256
    FROM counted JOIN below USING (path)"""
