"""Document fingerprints: Merkle trees of sections, paragraphs and their pieces; DataFrame operations only.

A text is cut, without loss, into pieces: a piece ends after a line break or a mark, or at LONGEST
code points. The leaves are hashes of pieces. A paragraph ends with a line break; its node is a hash over
its leaves. A section ends after a paragraph whose hash ends in one of SECTION_ENDS, so an insertion moves
no later section's bounds; its node is a hash over its paragraphs' hashes, and the root one over the
sections'. Leaves enter the hashes above them with 63 bits and are written with 32, so equal roots mean
equal texts. A fingerprint writes the tree down: ``root:section=paragraph>leaf.leaf,paragraph>leaf|section=…``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.barrier import bind, computed_once
from linkloom.llm.batches import whole_text
from linkloom.operators.numbering import with_dense_ids

LONGEST = 64
SECTION_ENDS = "08"
_PIECE = r"[^\n.,;:!?|]{1,%d}(?:[.,;:!?|]? ?\n?)|[\n.,;:!?|] ?" % LONGEST


def pieces(text: Column) -> Column:
    """The pieces of a text; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def leaves(text: Column) -> Column:
    """A 63-bit hash of every piece, above a bit that tells whether a paragraph ends with it."""

    def leaf(piece: Column) -> Column:
        ends = F.endswith(piece, F.lit("\n")).cast("int").cast("long")
        return F.xxhash64(piece).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(ends)

    return F.transform(pieces(text), leaf)


def short(leaf_array: Column) -> Column:
    """Leaves as they are written, for likeness."""
    return F.transform(leaf_array, lambda x: F.shiftright(x, 32).cast("int"))


def _hash(text: Column, digits: int = 16) -> Column:
    return F.left(F.sha2(text, 256), F.lit(digits))


def tree(leaf_array: Column) -> Column:
    """The fingerprint of leaves. Every level is cut by one split, so the work is linear."""

    def marked(leaf: Column) -> Column:
        mark = F.when(leaf.bitwiseAND(F.lit(1).cast("long")) == 1, ";").otherwise(".")
        return F.concat(F.lower(F.lpad(F.hex(leaf), 16, "0")), mark)

    def node(paragraph: Column) -> Column:
        written = F.regexp_replace(paragraph, "([0-9a-f]{8})[0-9a-f]{8}", "$1")
        return F.concat(_hash(paragraph), F.lit(">"), written)

    def ended(paragraph: Column) -> Column:
        mark = F.when(F.substring(paragraph, 16, 1).isin(*SECTION_ENDS), "|").otherwise(",")
        return F.concat(paragraph, mark)

    def section(paragraphs: Column) -> Column:
        return F.concat(_hash(F.regexp_replace(paragraphs, ">[0-9a-f.]*", "")), F.lit("="), paragraphs)

    def rooted(sections: Column) -> Column:
        hashes = F.transform(sections, lambda s: F.left(s, F.lit(16)))
        return F.concat(_hash(F.array_join(hashes, ""), 32), F.lit(":"), F.array_join(sections, "|"))

    joined = F.regexp_replace(F.array_join(F.transform(leaf_array, marked), ""), "[.;]$", "")
    nodes = F.transform(F.transform(F.split(joined, ";"), node), ended)
    cut = F.split(F.regexp_replace(F.array_join(nodes, ""), "[|,]$", ""), r"\|")
    return bind(F.transform(cut, section), rooted)


def fingerprint(text: Column) -> Column:
    return tree(leaves(text))


def leaves_of(print_: Column) -> Column:
    """The leaves written in a fingerprint, in order; none for an empty text."""
    own = F.regexp_replace(F.substring_index(print_, ":", -1), "[0-9a-f]{16}[=>]", "")
    return F.filter(F.split(own, "[.,|]"), lambda x: x != "")


def root_of(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def _overlap(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def likeness(a: Column, b: Column) -> Column:
    """1.0 for equal roots, else the share of leaves both fingerprints have (Dice, distinct leaves)."""
    return F.when(root_of(a) == root_of(b), F.lit(1.0)).otherwise(_overlap(leaves_of(a), leaves_of(b)))


def edits(a: Column, b: Column) -> Column:
    """Numbers of the sections of ``b`` that ``a`` lacks, in each the numbers of the paragraphs that ``a``
    lacks, and in each of these the places of its new leaves.

    Sections and paragraphs that both have are passed over by their hash alone.
    """
    branch = lambda p: F.split(F.substring_index(p, ":", -1), r"\|")
    sections = F.transform(branch(a), lambda s: F.left(s, F.lit(16)))
    paragraphs = F.regexp_extract_all(a, F.lit("([0-9a-f]{16})>"), F.lit(1))
    old = leaves_of(a)

    def numbered(parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x")))

    def lacking(parts: Column, known: Column) -> Column:
        return F.filter(numbered(parts), lambda p: ~F.array_contains(known, F.left(p["x"], F.lit(16))))

    def places(paragraph: Column) -> Column:
        new = F.filter(numbered(F.split(F.substring_index(paragraph, ">", -1), r"\.")), lambda x: ~F.array_contains(old, x["x"]))
        return F.transform(new, lambda x: x["i"])

    def changed(section: Column) -> Column:
        own = lacking(F.split(F.substring_index(section, "=", -1), ","), paragraphs)
        return F.transform(own, lambda p: F.struct(p["i"].alias("paragraph"), places(p["x"]).alias("leaves")))

    return F.transform(
        lacking(branch(b), sections), lambda s: F.struct(s["i"].alias("section"), changed(s["x"]).alias("paragraphs"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row. A null text is empty; other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """For every doc_id: of_id, the one whose next document it is, and how many code points that takes.

    Only ids and lengths are sorted. The next document of a doc_id is the next smaller doc_id; after
    the smallest comes the largest; null sorts below all numbers.
    """
    ids = rows.groupBy("doc_id").agg(F.max(F.floor(F.col("n_chars") / 3)).cast("int").alias("taken"))
    ranked = with_dense_ids(ids, [F.col("doc_id").desc_nulls_last()], "rank", start=0)
    total = ranked.count()
    target = ranked.select(
        F.col("doc_id").alias("of_id"), "taken", ((F.col("rank") + 1) % F.lit(max(total, 1))).alias("next_rank")
    )
    return target.join(ranked.select(F.col("doc_id").alias("next_id"), "rank"), F.col("next_rank") == F.col("rank")).select(
        "next_id", "of_id", "taken"
    )


def _key(name: str, key: str) -> list[Column]:
    """An id as two columns without nulls, so that windows and joins on it share one shuffle."""
    return [F.coalesce(F.col(name), F.lit(0)).alias(key), F.col(name).isNull().alias(f"{key}_null")]


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness.

    The edited text has the last floor(n_chars / 3) code points replaced by as many (or all) of the
    next document, descending doc_id. Rows that share a doc_id are compared each, with the same next
    document; a doc_id's first row by text stands for it as a next document. A table of one document
    has itself as the next. Null texts are empty; an empty table gives no rows; other columns are not
    looked at.

    Whole texts are shuffled once, by doc_id. A document then sends the document before it just the
    code points that it takes, with the fingerprint.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    near = _neighbours(rows.select("doc_id", F.length("text").alias("n_chars")))
    near = near.select(*_key("next_id", "n"), *_key("of_id", "o"), "taken")
    keyed = rows.select(*_key("doc_id", "k"), "text")
    found = keyed.join(near, (F.col("k") == F.col("n")) & (F.col("k_null") == F.col("n_null")))
    same = Window.partitionBy("k", "k_null").orderBy(F.xxhash64("text"), "text")
    found = found.withColumn("copy", F.row_number().over(same)).where("copy = 1")
    found = computed_once(found, ["o", "o_null", "text", "taken"], [leaves(F.col("text")).alias("leaves")])
    sent = found.select(
        "o", "o_null", F.left("text", F.col("taken")).alias("next_text"),
        F.array_distinct(short(F.col("leaves"))).alias("next_leaves"), root_of(tree(F.col("leaves"))).alias("next_root"),
    )
    met = keyed.join(sent, (F.col("k") == F.col("o")) & (F.col("k_null") == F.col("o_null")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next_text", third))
    told = met.select(
        F.when(~F.col("k_null"), F.col("k")).alias("doc_id"), n.cast("long").alias("n_chars"), "next_leaves", "next_root",
        leaves(F.col("text")).alias("leaves"), edited.alias("edited"),
    )
    told = _once(told, ["leaves", "edited"])
    told = told.select(
        "doc_id", "n_chars", "next_leaves", "next_root", "leaves", F.sha2("edited", 256).alias("edited_sha256"),
        tree(F.col("leaves")).alias("fingerprint"), leaves(F.col("edited")).alias("edited_leaves"),
    )
    told = _once(told, ["edited_leaves", "fingerprint"])
    told = told.withColumn("edited_fingerprint", tree(F.col("edited_leaves")))
    told = _once(told, ["edited_fingerprint"])
    root = root_of(F.col("fingerprint"))
    near_edited = F.when(F.col("fingerprint") == F.col("edited_fingerprint"), F.lit(1.0))
    near_next = F.when(root == F.col("next_root"), F.lit(1.0))
    return told.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        near_edited.otherwise(_overlap(short(F.col("leaves")), short(F.col("edited_leaves")))).alias("near_edited"),
        near_next.otherwise(_overlap(short(F.col("leaves")), F.col("next_leaves"))).alias("near_next"),
    )


def _once(df: DataFrame, names: list[str]) -> DataFrame:
    """The same table with the named columns evaluated once, whatever reads them."""
    kept = [c for c in df.columns if c not in names]
    return computed_once(df, kept, [F.col(c) for c in names])
