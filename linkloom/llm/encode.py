"""Encoding whole texts with a public tokenizer, each distinct word once per Python worker.

Both tokenizers split a text before they merge, and never across the places cut here: before white
space that follows other characters. So the ids of a text are the ids of its words, one after the
other, and a word's ids can be kept. Texts with runs of white space are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from linkloom.llm.batches import kept
from linkloom.llm.batches import runs as _runs

# A worker keeps at most this many words; then it starts anew. Bounds memory, never the result.
CACHED_WORDS = 1_400_000
LONGEST_CACHED = 128
# White space before white space; a text of plain ASCII without one of these has none.
_ODD_SPACE = re.compile(r"\s[ \n]|\x00")
_ODD_ASCII = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\0")


def tokenizer_path(name: str) -> str:
    """Where the tokenizer files of this machine lie; every executor has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pool:
    """A growing array."""

    def __init__(self, kind: str) -> None:
        self.data, self.size = np.empty(1 << 16, dtype=kind), 0

    def extend(self, values) -> None:
        more = len(values)
        if self.size + more > len(self.data):
            grown = np.empty(max(2 * len(self.data), self.size + more), dtype=self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : self.size + more] = values
        self.size += more

    def view(self) -> np.ndarray:
        return self.data[: self.size]


class _Numbers(dict):
    """Numbers words in the order they are first met, and keeps the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.given = 0
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = self.given
        self.given += 1
        self.fresh.append(key)
        return number


class TextEncoder:
    """ids of texts by the tokenizers library, without special tokens.

    ``spaced``: white space stands before a word and is part of its ids (byte-level BPE); otherwise
    it is dropped. With ``offsets`` the code points of every token are kept as well.
    """

    def __init__(self, file: str, spaced: bool, offsets: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(file))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaced, self.offsets = spaced, offsets
        self._forget()

    def _forget(self) -> None:
        self.words = _Numbers()
        self.ids, self.begins, self.ends = _Pool("u4"), _Pool("i8"), _Pool("i8")
        self.starts, self.lengths, self.chars = _Pool("i8"), _Pool("i8"), _Pool("i8")

    def _learn(self) -> None:
        """Encode the words met for the first time."""
        fresh, self.words.fresh = self.words.fresh, []
        if not fresh:
            return
        chunks = [self._chunk(key) for key in fresh] if self.spaced else fresh
        if self.offsets:
            found = self.tokenizer.encode_batch(chunks, add_special_tokens=False)
            spans = [span for e in found for span in e.offsets]
            self.begins.extend([b for b, _ in spans])
            self.ends.extend([e for _, e in spans])
            self.chars.extend([len(c) for c in chunks])
        else:
            found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        ids = [e.ids for e in found]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.starts.extend(self.ids.size + np.cumsum(lengths) - lengths)
        self.lengths.extend(lengths)
        self.ids.extend(np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lengths.sum())))
        for key in fresh:
            if len(key) > LONGEST_CACHED:
                del self.words[key]

    def _parts(self, text: str) -> list[str]:
        """Keys of a text's words. A text that cannot be cut is one key, with two marks before it."""
        if not self.spaced:
            text = text.lower() if text.isascii() and not self.offsets else text
            return text.replace("\n", " ").split(" ")
        if not (text.isascii() and not any(map(text.__contains__, _ODD_ASCII))) and _ODD_SPACE.search(text):
            return ["\0\0" + text]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    @staticmethod
    def _chunk(key: str) -> str:
        """The characters a key stands for."""
        if key.startswith("\0"):
            return key[2:] if key.startswith("\0\0") else key[1:]
        return key if key.startswith("\n") else " " + key

    def encode(self, texts: list[str]) -> dict[str, np.ndarray]:
        """ids of all texts one after the other, lengths by text; begins and ends if asked for."""
        if self.words.given > CACHED_WORDS or self.ids.size > 16 * CACHED_WORDS:
            self._forget()
        split = [self._parts(text) for text in texts]
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        number = self.words.__getitem__
        index = np.fromiter(map(number, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
        self._learn()
        lengths = self.lengths.view()[index]
        at = _runs(self.starts.view()[index], lengths)
        out = {"ids": self.ids.view()[at], "lengths": _sums(lengths, counts)}
        if self.offsets:
            extent = self.chars.view()[index] + (0 if self.spaced else 1)
            before = np.cumsum(extent) - extent
            first = np.cumsum(counts) - counts
            place = np.repeat(before - np.repeat(before[first], counts), lengths)
            out["begins"] = self.begins.view()[at] + place
            out["ends"] = self.ends.view()[at] + place
        return out


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each consecutive group of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    last = np.cumsum(counts)
    return total[last] - total[last - counts]


def encoder(file: str, spaced: bool, offsets: bool = False) -> TextEncoder:
    """The worker's encoder; it lives until the worker keeps something else."""
    return kept("encoder", (file, spaced, offsets), lambda: TextEncoder(file, spaced, offsets))
