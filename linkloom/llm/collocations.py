"""Collocations of every language, mined from a prefix-free parse of the texts.

A text's words, with the breaks between its pieces, are cut where the hash of two neighbouring words
says so: a chunk begins at such a pair and ends with the next one, so neighbours share two words, and
equal passages give equal chunks wherever they stand. The distinct chunks with their frequencies are
the dictionary. Phrases are counted inside each distinct chunk once and weighted; one that begins in
the two shared words at a chunk's end belongs to the next chunk, so every occurrence counts once.

Phrases are counted length by length. A phrase of k words occurs often only if both phrases of k - 1
words in it do, so a Bloom filter over the frequent ones tells tasks which to pass over. Its size is
bounded; beyond that it lets more pass, and the counts that follow are exact in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.batches import runs, slices, whole_text
from linkloom.llm.shingles import mixed
from linkloom.session import stage

SHARED = 2  # words that neighbouring chunks have in common: one less than the longest phrase
SPAN = 24  # words between cuts, on average
LEAST = 10
COVERED = 50  # percent
MOST = 2000
HOT_SHARE = 1000  # a part that stands for over 1/HOT_SHARE of all words is hot; there are fewer than 2000
FILTER_BITS = 1 << 28
SPACE, BREAK = 0x20, 0x0A
_BREAKS = [*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]
_KIND = np.zeros(256, dtype=np.uint8)  # 0: part of a word, 1: space, 2: break
_KIND[[0x20, 0x09]] = 1
_KIND[_BREAKS] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# what is left of eight bytes if a word has fewer
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words by their first and last eight bytes and their length; for cuts and filters only."""
    padded = np.concatenate([np.zeros(8, dtype=np.uint8), raw, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded.tobytes(), strides=1)
    length = ends - starts
    head = eight[starts + 8] & _MASKS[np.minimum(length, 8)]
    tail = np.where(length > 8, eight[ends], np.uint64(0))
    return mixed(mixed(head, 3) + mixed(tail, 4) + length.astype(np.uint64), 5)


def _strings(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow array of strings."""
    data = raw[runs(starts, lengths)]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins and the last ends."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def chunks_of(texts: pa.Array, span: int = SPAN) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of its text, the words and whether it is the last one of its text, for every chunk.

    Words are separated by a space, by a line feed where a piece ends between them; A-Z lowered.
    """
    raw, offsets = _bytes_of(texts)
    kind = _KIND[raw]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    final = inside.copy()
    final[:-1] &= ~inside[1:]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = inside[begins]
    final[begins[1:] - 1] = inside[begins[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.int64), pa.array([], pa.large_string()), np.zeros(0, dtype=bool)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    lowered = _LOWER[raw]
    breaks = np.flatnonzero(kind == 2)
    gap = np.searchsorted(breaks, starts)
    broken = np.append(np.diff(gap) > 0, False)  # a break follows the word
    hashes = _hashes(lowered, starts, ends)
    new = np.append(True, owner[1:] != owner[:-1])  # a text's first word
    pair = hashes * np.uint64(3) + np.append(hashes[1:], np.uint64(0)) + broken.astype(np.uint64)
    cut = (mixed(pair, 6) % np.uint64(span) == 0) & ~np.append(new[1:], True)
    heads = np.flatnonzero(cut | new)
    ends_text = np.append(new[heads[1:]], True)
    tails = np.append(heads[1:], len(starts)) + np.where(ends_text, 0, SHARED)
    # the words again, each with one byte behind it
    lengths = ends - starts + 1
    places = np.cumsum(lengths) - lengths
    text = np.append(lowered, np.uint8(0))[runs(starts, lengths)]
    text[places + lengths - 1] = np.where(broken, BREAK, SPACE)
    until = places[tails - 1] + lengths[tails - 1] - 1
    return owner[heads], _strings(text, places[heads], until - places[heads]), ends_text


def dictionary(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """lang, chunk, last, times: the distinct chunks of every language and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, chunks, last = chunks_of(part.column("text"), span)
                columns = [part.column("lang").take(pa.array(owner)), chunks.cast(pa.string()), pa.array(last)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "last"])

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    parsed = docs.select(lang, whole_text().alias("text")).mapInArrow(run, "lang string, chunk string, last boolean")
    return parsed.groupBy("lang", "chunk", "last").agg(F.count(F.lit(1)).alias("times"))


class BloomFilter:
    """Bits of the hashes of frequent phrases."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.size = bits, np.uint64(64 * len(bits))

    def fits(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % self.size
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _phrase_hashes(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases, by the hashes of their language and of each of their words."""
    value = langs
    for word in words:
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + word, 9)
    return value


def _word_hashes(words: pa.Array) -> np.ndarray:
    raw, offsets = _bytes_of(words)
    return _hashes(raw, offsets[:-1], offsets[1:])


def bloom_filter(phrases: DataFrame, size: int, most_bits: int = FILTER_BITS) -> BloomFilter:
    """A filter over ``phrases`` (lang, phrase) of ``size`` words; at most ``most_bits`` large, by its rows."""
    wanted = 16 * phrases.count()
    bits = 1 << max(10, min(wanted - 1, most_bits - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = _word_hashes(batch.column("lang"))
            words = pc.split_pattern(batch.column("phrase"), " ").flatten()
            words = _word_hashes(words).reshape(-1, size)
            at = np.unique(_phrase_hashes(langs, list(words.T)) % np.uint64(bits))
            cell, start = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int64)), pa.array(value.view(np.int64))], ["cell", "value"]
            )

    cells = phrases.select("lang", "phrase").mapInArrow(run, "cell long, value long")
    found = cells.groupBy("cell").agg(F.bit_or("value").alias("value")).toArrow()  # bits / 64 rows at most
    filled = np.zeros(bits // 64, dtype=np.uint64)
    filled[found.column("cell").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    return BloomFilter(filled)


def _counted(
    langs: pa.Array, chunks: pa.Array, last: np.ndarray, times: np.ndarray, size: int, known: BloomFilter | None
) -> pa.RecordBatch | None:
    """lang, phrase, f of the phrases of ``size`` words that begin in chunks and not in a shared end."""
    raw, offsets = _bytes_of(chunks)
    if not len(raw):
        return None
    # a byte behind every chunk, so that each word has one: a break
    lengths = np.diff(offsets)
    text = np.full(len(raw) + len(lengths), BREAK, dtype=np.uint8)
    text[runs(offsets[:-1] + np.arange(len(lengths)), lengths)] = raw
    gaps = np.flatnonzero((text == SPACE) | (text == BREAK))
    starts = np.append(0, gaps[:-1] + 1)
    keep = np.ones(len(text), dtype=bool)
    keep[gaps] = False
    words = np.append(0, np.cumsum(gaps - starts))
    words = pa.LargeStringArray.from_buffers(len(gaps), pa.py_buffer(words), pa.py_buffer(text[keep]))
    coded = words.dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    joined = text[gaps] == SPACE  # with the next word in one piece
    bounds = np.searchsorted(starts, offsets + np.arange(len(offsets)))
    owner = np.repeat(np.arange(len(lengths)), np.diff(bounds))
    begins = np.ones(len(word), dtype=bool)
    if size <= SHARED + 1:
        inner = ~last
        for k in range(SHARED):
            begins[bounds[1:][inner] - 1 - k] = False
    tongue = langs.dictionary_encode()
    lang = tongue.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(begins)
    for k in range(size - 1):
        at = at[joined[at + k]]
    if known is not None and len(at):
        spelled = _word_hashes(coded.dictionary)
        spoken = _word_hashes(tongue.dictionary)[lang[owner[at]]]
        for part in range(2):
            fits = known.fits(_phrase_hashes(spoken, [spelled[word[at + part + k]] for k in range(size - 1)]))
            at, spoken = at[fits], spoken[fits]
    if not len(at):
        return None
    # numbers of phrases: language and first word, then word by word
    wide = np.int64(len(coded.dictionary))
    number = lang[owner[at]] * wide + word[at]
    for k in range(1, size):
        _, number = np.unique(number, return_inverse=True)
        number = number * wide + word[at + k]
    order = np.argsort(number, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(number[order]) > 0))
    f = np.add.reduceat(times[owner[at[order]]], heads)
    sample = at[order[heads]]
    spelt = [coded.dictionary.take(pa.array(word[sample + k])) for k in range(size)]
    phrase = pc.binary_join_element_wise(*spelt, pa.scalar(" ", pa.large_string())) if size > 1 else spelt[0]
    spoken = tongue.dictionary.take(pa.array(lang[owner[sample]]))
    return pa.RecordBatch.from_arrays(
        [spoken.cast(pa.string()), phrase.cast(pa.string()), pa.array(f)], ["lang", "phrase", "f"]
    )


def frequencies(chunks: DataFrame, size: int, known: BloomFilter | None = None) -> DataFrame:
    """lang, phrase, f: occurrences of the phrases of ``size`` words (SHARED + 1 at most) in a dictionary.

    With ``known``, a filter over phrases of one word less, those go that have a part it doesn't hold.
    """
    if not 1 <= size <= SHARED + 1:
        raise ValueError(f"phrases have 1 to {SHARED + 1} words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "chunk"):
                last = part.column("last").to_numpy(zero_copy_only=False)
                times = part.column("times").to_numpy(zero_copy_only=False)
                found = _counted(part.column("lang"), part.column("chunk"), last, times, size, known)
                if found is not None:
                    yield found

    counted = chunks.select("lang", "chunk", "last", "times").mapInArrow(run, "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _with_count(cuts: DataFrame, parts: DataFrame, hot: DataFrame, part: str, name: str) -> DataFrame:
    """Add ``name``, the frequency of the phrase in column ``part``.

    Many cuts may have one part. Those of a hot part, and there are fewer than 2 * HOT_SHARE of them by
    arithmetic, get its count from a broadcast table; of any other part there are few cuts, as each
    has LEAST occurrences, and they are shuffled.
    """
    key = ["lang", part]
    few = hot.select("lang", F.col("phrase").alias(part), F.col("f").alias("hot_f"))
    rest = parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    marked = cuts.join(F.broadcast(few), key, "left")
    warm = marked.where("hot_f IS NOT NULL").withColumnRenamed("hot_f", name)
    cold = marked.where("hot_f IS NULL").drop("hot_f").join(rest, key)
    return cold.unionByName(warm)


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``most`` best collocations.

    ``docs``: lang, text. Candidates are phrases of 2 and 3 words inside one piece that occur at least
    ``least`` times; a, l, r and n are the occurrences of the phrase, of the parts left and right of its
    weakest cut, and of all words of the language. Candidates inside a longer candidate that has at
    least ``covered`` percent of their occurrences go. A null text is empty and has no words, a null
    lang is ``und``, as the string. Repeated rows count as often as they stand. Ties of score go by a,
    then by the phrase's bytes. An empty table, or one without candidates, gives no rows; other columns
    are not looked at. A text may have any length; a task parses 4 MB, or one longer text, at a time.
    """
    chunks = stage(dictionary(docs))
    words = stage(frequencies(chunks, 1))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = [stage(words.where(F.col("f") >= least))]
    for size in (2, 3):
        known = bloom_filter(often[-1], size - 1)
        often.append(stage(frequencies(chunks, size, known).where(F.col("f") >= least)))
    parts = often[0].unionByName(often[1])
    every = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    hot = stage(parts.where(F.col("f") * HOT_SHARE > every))

    split = F.split("phrase", " ")
    cuts = None
    for size, found in ((2, often[1]), (3, often[2])):
        for k in range(1, size):
            first = F.array_join(F.slice(split, 1, k), " ")
            rest = F.array_join(F.slice(split, k + 1, size - k), " ")
            one = found.select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"), first.alias("first"), rest.alias("rest"))
            cuts = one if cuts is None else cuts.unionByName(one)
    cuts = _with_count(_with_count(cuts, parts, hot, "first", "l"), parts, hot, "rest", "r")

    def wide(column: str) -> Column:
        return F.col(column).cast("decimal(15,0)")

    weight = wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")
    cuts = cuts.withColumn("weight", weight).withColumn("chance", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("weight DIV chance"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    longer = often[2].select(
        "lang",
        F.col("f").alias("around"),
        F.explode(F.array(*[F.array_join(F.slice(split, k, 2), " ") for k in (1, 2)])).alias("phrase"),
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = scored.join(longer, ["lang", "phrase"], "left")
    kept = kept.where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a"))).drop("around")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(32))
    kept = kept.withColumn("share", share)
    some = Window.partitionBy("lang", "share").orderBy(*best)
    kept = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= most)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    kept = kept.where(F.col("rank") <= most).join(totals, "lang")
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def counterpart(least: int = LEAST, covered: int = COVERED, most: int = MOST) -> str:
    """The same rows in SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), lists AS (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]'), lambda w: w <> '') AS w FROM pieces
    ), grams AS (
        SELECT lang, 1 AS k, unnest(w) AS phrase FROM lists UNION ALL
        SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists UNION ALL
        SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
        FROM lists
    ), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
    totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    often AS (SELECT * FROM f WHERE f >= {least}),
    cuts AS (
        SELECT lang, k AS size, phrase, f AS a, cut, array_to_string(string_split(phrase, ' ')[1 : cut], ' ') AS first,
               array_to_string(string_split(phrase, ' ')[cut + 1 : k], ' ') AS rest
        FROM often JOIN (VALUES (1), (2)) AS c(cut) ON cut < k
    ), scored AS (
        SELECT c.lang, size, c.phrase, a, cut, x.f AS l, y.f AS r,
               CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = first AND x.k = cut
             JOIN f y ON y.lang = c.lang AND y.phrase = rest AND y.k = size - cut
    ), weakest AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
    ), around AS (
        SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1 : 2], ' '), array_to_string(string_split(phrase, ' ')[2 : 3], ' ')]) AS phrase, f
        FROM often WHERE k = 3
    ), kept AS (
        SELECT * FROM weakest w WHERE size = 3 OR NOT EXISTS (
            SELECT 1 FROM around o WHERE o.lang = w.lang AND o.phrase = w.phrase AND 100 * o.f >= {covered} * w.a)
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {most}"""
