"""Hashes of words and word shingles for many texts at once, with numpy over their UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = values + np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(bits: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(1 << bits, _BASE, dtype=np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text.

    Words are what lies between spaces, tabs, line feeds and the like (20, 09 to 0D); A-Z lowered.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    counts = np.zeros(len(texts), dtype=np.int64)
    if end == begin:
        return np.zeros(0, dtype=np.uint64), counts
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[begin:end]
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[:-1][np.diff(offsets) > 0] - begin
    first[bounds] = inside[bounds]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    number = np.cumsum(first) - 1
    place = np.arange(len(raw)) - starts[np.maximum(number, 0)]
    place[~inside] = 0
    powers = _powers(max(10, int(place.max()).bit_length()))
    values = (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers[place]
    values[~inside] = 0
    hashes = mixed(np.add.reduceat(values, starts))
    at = np.searchsorted(starts, offsets - begin, side="left")
    return hashes, np.diff(at)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted; a shorter text's words are one shingle."""
    hashes, counts = word_hashes(texts)
    factors = mixed(np.arange(1, words + 1, dtype=np.uint64), 7) | np.uint64(1)
    chained = np.zeros(max(len(hashes) - words + 1, 0), dtype=np.uint64)
    for i in range(words):
        chained += hashes[i : i + len(chained)] * factors[i]
    chained = mixed(chained)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(chained[at : at + n - words + 1]))
        elif n:
            short = (hashes[at : at + n] * factors[:n]).sum(dtype=np.uint64)
            out.append(mixed(np.array([short], dtype=np.uint64), n))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out
