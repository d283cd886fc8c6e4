"""Token counts by section, from one encoding of the whole document.

Sections are encoded with everything around them, so their counts add up to the document's count; a
section's text encoded alone would be split elsewhere. Token spans and section spans are both in
order, so the interval join is a binary search of spans in section starts, for many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.batches import slices, whole_text
from linkloom.llm.encode import encoder

TOKENIZER = "byte_bpe_50k.json"
RULES = ("first", "last", "majority")
SCHEMA = "doc_id long, section int, begin long, end long, n_tokens long, n_crossing long, doc_tokens long"


def _owner(begins, ends, starts, last, rule: str):
    """Section of each token, and whether its characters lie in several."""
    of_first = np.searchsorted(starts, begins, side="right") - 1
    of_last = np.searchsorted(starts, np.maximum(ends - 1, begins), side="right") - 1
    of_last = np.minimum(of_last, last)
    crossing = of_last > of_first
    if rule == "last":
        return of_last, crossing
    owner = of_first
    if rule == "majority":
        owner = of_first.copy()
        for token in np.flatnonzero(crossing):
            bounds = np.append(starts[of_first[token] : of_last[token] + 1], ends[token])
            bounds[0] = begins[token]
            owner[token] += int(np.argmax(np.diff(bounds)))
    return owner, crossing


def section_token_counts(docs: DataFrame, rule: str = "first", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per section of every document.

    A section is a line with its line break; a text without line break has one, also the empty and
    the null text. begin and end are code points. A token whose characters lie in several sections
    goes to the section of its first character (``first``), of its last one (``last``), or to the
    one with most of its characters, the earlier one of equals (``majority``); it counts once, and as
    crossing in the section it goes to. A character of several tokens is in the span of each.
    doc_tokens is the whole document's count and the sum over its sections. Rows that share a doc_id
    are counted apart; an empty table gives no rows; other columns are not looked at.
    """
    if rule not in RULES:
        raise ValueError(f"rule has to be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaced=True, offsets=True).encode
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = part.column("text").to_pylist()
                found = encode(texts)
                chars = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
                base = np.cumsum(chars) - chars
                # documents follow each other on one axis; an empty one has a place of its own
                lines = [text.split("\n") for text in texts]
                lines = [k[:-1] if len(k) > 1 and not k[-1] else k for k in lines]
                counts = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
                sizes = np.fromiter((len(x) + 1 for k in lines for x in k), dtype=np.int64)
                row = np.repeat(np.arange(len(texts)), counts)
                first = np.cumsum(counts) - counts
                begin = np.cumsum(sizes) - sizes
                begin -= begin[first][row]
                number = np.arange(len(row)) - first[row]
                end = np.minimum(begin + sizes, chars[row])
                starts = begin + base[row] + row  # one more place between documents
                doc_of = np.repeat(np.arange(len(texts)), found["lengths"])
                shift = (base + np.arange(len(texts)))[doc_of]
                last = (first + counts - 1)[doc_of]
                owner, crossing = _owner(found["begins"] + shift, found["ends"] + shift, starts, last, rule)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(row)),
                        "section": pa.array(number, pa.int32()),
                        "begin": pa.array(begin, pa.int64()),
                        "end": pa.array(end, pa.int64()),
                        "n_tokens": pa.array(np.bincount(owner, minlength=len(row)), pa.int64()),
                        "n_crossing": pa.array(np.bincount(owner[crossing], minlength=len(row)), pa.int64()),
                        "doc_tokens": pa.array(found["lengths"][row], pa.int64()),
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(count, SCHEMA)
