"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

A seed is a mask over consecutive words; words at ignored places may differ. Every place of every
document and every place of every benchmark text gives one hash per mask. Equal hashes name a
benchmark text and an alignment, and the words around are compared along it, so passages with
replaced words are found as well. Whatever the overlap rule accepts has a place where one of the
masks fits the equal words: replacing so many words that none fits breaks the rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.barrier import bind, computed_once
from linkloom.llm.batches import free_name, whole_text
from linkloom.session import stage

#: Fewest words of a benchmark text and its masks. Proved for 13 to 25 words, longer texts consist of such parts.
MASKS = (
    (13, ("11101", "10010011", "1100101")),
    (5, ("11101", "100111", "1101001", "1110001", "10111", "11011", "1111")),
    (4, ("111", "1101", "1011")),
    (3, ("111",)),
    (2, ("11",)),
    (1, ("1",)),
)
EXACT = 3  # a benchmark text of so many words overlaps only as a whole, which its mask says already
LEAST_SHARE = 0.7  # of the benchmark text's words, or
WINDOW, LEAST_IN_WINDOW = 16, 13  # so many equal words among consecutive ones
BROADCAST_ROWS = 200_000  # benchmark seeds or alignments; a row has 32 bytes
_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words; words are runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), _WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, masks: Sequence[str]) -> DataFrame:
    """One row per place and mask: the columns of df but ``words``, with place and seed."""
    kept = [c for c in df.columns if c != "words"]
    places = F.sequence(F.lit(0), F.size("words") - 1)
    rows = df.where(F.size("words") > 0).select(*kept, "words", F.explode(places).alias("place"))
    hashes = []
    for mask in masks:
        chosen = [F.get("words", F.col("place") + i) for i, bit in enumerate(mask) if bit == "1"]
        whole = F.col("place") + len(mask) <= F.size("words")
        hashes.append(F.when(whole, F.xxhash64(F.lit(mask), *chosen)))
    return rows.select(*kept, "place", F.explode(F.array(*hashes)).alias("seed")).where("seed IS NOT NULL")


def _masks_of(words: Column) -> Column:
    """The number in MASKS for a benchmark text."""
    return F.coalesce(*[F.when(F.size(words) >= least, F.lit(i)) for i, (least, _) in enumerate(MASKS)])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_word, matched, item_words and densest of every verified overlap.

    An overlap holds if at least LEAST_SHARE of the benchmark text's words stand at their places, or
    LEAST_IN_WINDOW of WINDOW consecutive ones. ``doc_word`` is where the benchmark text would begin
    (negative if the document begins inside it); the alignment with most equal words is returned, the
    first of equals. Null and wordless texts overlap nothing. Equal benchmark texts are matched once
    and each reported. Rows that share a doc_id are searched each and reported together. Either table
    may be empty; other columns are not looked at.

    Seeds of the documents meet those of the benchmark in the scan's own tasks while the benchmark
    has at most BROADCAST_ROWS seeds; a larger one is joined by a shuffle on the seed. Documents are
    seeded by the masks of the lengths that the benchmark has. The alignments of a document and a
    benchmark text are one written row; of texts of up to EXACT words just the first, which needs no
    comparison. So few rows go to the documents, for more the documents are shuffled; either way a
    document's words are hashed once more, however many alignments it has.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(whole_text()).alias("words"))
    distinct = items.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
    distinct = distinct.withColumn("item", F.xxhash64("words"))
    sized = distinct.select("item", "words", _masks_of(F.col("words")).alias("kind"), (F.size("words") <= EXACT).alias("exact"))
    kinds = sorted(r.kind for r in sized.select("kind").distinct().collect()) or [0]
    parts = [_seeds(sized.where(F.col("kind") == k).drop("kind"), MASKS[k][1]) for k in kinds]
    masks = list(dict.fromkeys(m for k in kinds for m in MASKS[k][1]))
    seeds = reduce(DataFrame.unionByName, parts).select("seed", "item", "exact", F.col("place").alias("item_place"))
    if seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    hits = _seeds(texts.select("doc_id", word_hashes(F.col("text")).alias("words")), masks).join(seeds, "seed")
    doc_word = F.col("place") - F.col("item_place")
    hits = stage(
        hits.groupBy("doc_id", "item").agg(
            F.min(F.when(F.col("exact"), doc_word)).alias("first"),
            F.collect_set(F.when(~F.col("exact"), doc_word)).alias("places"),
        )
    )
    whole = hits.where("first IS NOT NULL").join(distinct, "item").select(
        "doc_id", "item", "item_ids", F.col("first").alias("doc_word"),
        *[F.size("words").alias(n) for n in ("matched", "item_words", "densest")],
    )
    found = whole.unionByName(_compared(hits.where("first IS NULL"), texts, distinct))
    best = F.max_by(
        F.struct("item_ids", "doc_word", "matched", "item_words", "densest"),
        F.struct("matched", -F.col("doc_word")),
    )
    return (
        found.groupBy("doc_id", "item")
        .agg(best.alias("best"))
        .select("doc_id", F.explode("best.item_ids").alias("item_id"), "best.doc_word", "best.matched", "best.item_words", "best.densest")
    )


def _compared(hits: DataFrame, texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """The best alignment of every document and benchmark text that overlap along one of their ``places``."""
    rows, places = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    hits = hits.withColumnRenamed("doc_id", "hit_id")
    ids = hits.select("hit_id").distinct()
    if rows + places <= BROADCAST_ROWS:
        hits, ids = F.broadcast(hits), F.broadcast(ids)
    mine = F.col("hit_id").eqNullSafe(F.col("doc_id"))
    # hashed once, before a row for each benchmark text is made of it
    read = computed_once(texts.join(ids, mine, "left_semi"), ["doc_id"], [word_hashes(F.col("text")).alias("words")])
    met = read.join(hits, mine).join(distinct.withColumnRenamed("words", "item_hashes"), "item")
    size = F.size("item_hashes")

    def equal(at: Column) -> Column:
        """1 for every word of the benchmark text that stands at its place."""
        own = lambda i: F.get("words", F.greatest(i + at, F.lit(0)))
        return F.transform("item_hashes", lambda w, i: F.when((i + at >= 0) & (own(i) == w), 1).otherwise(0))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: a + b)

    def densest(same: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(same) - WINDOW + 1, F.lit(1)))
        return F.array_max(F.transform(starts, lambda s: total(F.slice(same, s, WINDOW))))

    def judged(at: Column) -> Column:
        def told(same: Column) -> Column:
            matched = total(same)
            enough = (matched >= LEAST_SHARE * size) | (densest(same) >= LEAST_IN_WINDOW)
            return F.struct(F.when(enough, matched).otherwise(-1).alias("matched"), (-at).alias("before"))

        return bind(equal(at), told)

    met = met.withColumn("best", F.array_max(F.transform("places", judged))).where("best.matched >= 0")
    at = -F.col("best.before")
    return met.select(
        "doc_id", "item", "item_ids", at.alias("doc_word"), F.col("best.matched").alias("matched"),
        size.alias("item_words"), densest(equal(at)).alias("densest"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that overlap no benchmark text."""
    name = free_name(docs, "hit_id")
    found = stage(overlaps(docs, benchmark).select(F.col("doc_id").alias(name)).distinct())
    found = F.broadcast(found) if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else found
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[name]), "left_anti")
