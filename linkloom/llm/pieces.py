"""SentencePiece ids of whole texts by merges in score order, and texts of ids.

A merge-type vocabulary joins adjacent symbols: of all adjacent pairs that are pieces together, the
one of best score is joined first, the leftmost of equals, until none is left. An agenda, a heap by
score and place, holds the pairs; a pair whose symbols have changed meanwhile is passed over. What is
no piece at the end is written as its bytes.

No piece has a space mark behind another character, and no longer piece has a line feed (the
vocabulary is checked for both). So a text can be cut before such places, and a worker merges each
distinct word once. Every word met for the first time is encoded by the sentencepiece library as
well, and every decoded text is compared with the library's, in the Arrow batch in which they come.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.batches import runs, slices, whole_text
from linkloom.llm.encode import _Numbers, _Pool, _sums, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"  # stands for a space
# A worker keeps at most this many words; then it starts anew. Bounds memory, never the result.
CACHED_WORDS = 700_000
SHORT = 64  # characters of words that are merged together, with numpy, and kept
NEVER = 2**31 - 1


class PieceModel:
    """A merge-type vocabulary: its own encoder and decoder, and the library's to check them by."""

    def __init__(self, file: str = MODEL, path: str | None = None) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path(file))
        size = self.library.get_piece_size()
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        surfaces = []
        for number in range(size):
            piece = self.library.id_to_piece(number)
            if self.library.is_byte(number):
                self.bytes[int(piece[1:-1], 16)] = number
                surfaces.append(bytes([int(piece[1:-1], 16)]))
            elif self.library.is_unknown(number):
                surfaces.append(" ⁇ ".encode())  # how the library shows an unknown symbol
            elif self.library.is_control(number):
                surfaces.append(b"")
            else:
                self.pieces[piece] = (-self.library.get_score(number), number)
                surfaces.append(piece.replace(MARK, " ").encode())
        plain = self.library.normalize("ﬁ Ａ  b ") == f"{MARK}ﬁ{MARK}Ａ{MARK}{MARK}b{MARK}"
        bounded = not any(
            MARK in p.lstrip(MARK) or (len(p) > 1 and "\n" in p) for p in self.pieces
        )
        if not (plain and bounded and all(self.bytes)):
            raise ValueError("the vocabulary changes characters, joins words or has no bytes to fall back on")
        self.surfaces = _Strings(surfaces)
        self.fronted = np.array([self.library.id_to_piece(number).startswith(MARK) for number in range(size)])
        self.decimals = _Strings([f"{number},".encode() for number in range(size)])
        self._tables(size)
        self.forget()

    def _tables(self, size: int) -> None:
        """Symbols are numbered: pieces by id, other characters of pieces above them. Of each pair that
        joins to a piece: its code, the rank of the piece's score (equal scores, equal ranks), the piece."""
        self.symbol = {piece: number for piece, (_, number) in self.pieces.items()}
        for character in sorted(set(chain.from_iterable(self.pieces))):
            self.symbol.setdefault(character, size + len(self.symbol))
        self.above = max(self.symbol.values()) + 2
        scores = sorted({score for score, _ in self.pieces.values()})
        rank = {score: n for n, score in enumerate(scores)}
        pairs = sorted(
            (self.symbol[piece[:cut]] * self.above + self.symbol[piece[cut:]], rank[score], number)
            for piece, (score, number) in self.pieces.items()
            for cut in range(1, len(piece))
            if piece[:cut] in self.symbol and piece[cut:] in self.symbol
        )
        if self.above**2 > NEVER:
            raise ValueError("too many pieces")
        self.codes, self.ranks, self.joins = np.array([*pairs, (NEVER, 0, 0)], dtype=np.int32).T.copy()
        self.character = np.full(0x110000, -1, dtype=np.int32)
        for piece, number in self.symbol.items():
            if len(piece) == 1:
                self.character[ord(piece)] = number

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.starts, self.lengths = _Pool("i4"), _Pool("i8"), _Pool("i8")

    def merged(self, word: str) -> list[int]:
        """ids of one word whose spaces are marks, by an agenda of its own: for long words."""
        pieces = self.pieces
        symbols = list(word)
        last = len(symbols) - 1
        before, after = list(range(-1, last)), list(range(1, last + 2))
        agenda: list[tuple] = []

        def consider(at: int, other: int) -> None:
            found = pieces.get(symbols[at] + symbols[other])
            if found:
                heapq.heappush(agenda, (found[0], at, symbols[at], symbols[other]))

        for at in range(last):
            consider(at, at + 1)
        while agenda:
            _, at, left, right = heapq.heappop(agenda)
            other = after[at]
            if symbols[at] != left or other > last or symbols[other] != right:
                continue
            symbols[at], symbols[other] = left + right, ""
            follows = after[at] = after[other]
            if follows <= last:
                before[follows] = at
                consider(at, follows)
            if before[at] >= 0:
                consider(before[at], at)
        ids: list[int] = []
        for symbol in filter(None, symbols):
            found = pieces.get(symbol)
            ids.extend([found[1]] if found else [self.bytes[b] for b in symbol.encode()])
        return ids

    def _agenda(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of symbols: rank and place in the word as one number, and what they join to."""
        code = left * np.int32(self.above) + right
        code[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.codes, code)
        fits = self.codes[at] == code
        return np.where(fits, self.ranks[at] * np.int32(SHORT) + place, np.int32(NEVER)), self.joins[at]

    def merged_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words of at most SHORT characters, one after the other, and their number by word.

        Every round takes the first pair of every word's agenda and joins it, for all words at once.
        """
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        characters = "".join(words)
        symbol = self.character[np.frombuffer(characters.encode("utf-32-le"), dtype="<u4")]
        starts = (np.cumsum(counts) - counts).astype(np.int32)
        place = np.arange(len(symbol), dtype=np.int32) - np.repeat(starts, counts)
        after = np.arange(1, len(symbol) + 1, dtype=np.int32)
        held = counts > 0
        after[(starts + counts - 1)[held]] = -1
        before = np.arange(-1, len(symbol) - 1, dtype=np.int32)
        before[starts[held]] = -1
        alive = np.ones(len(symbol), dtype=bool)
        key = np.full(len(symbol), NEVER, dtype=np.int32)
        join = np.zeros(len(symbol), dtype=np.int32)
        paired = np.flatnonzero(after >= 0)
        key[paired], join[paired] = self._agenda(symbol[paired], symbol[paired + 1], place[paired])
        # the agendas of words that still join: ``at`` holds their places, word after word
        at, heads = np.arange(len(symbol), dtype=np.int32), starts[held]
        while len(at):
            first = np.minimum.reduceat(key[at], heads)
            going = first < NEVER
            if not going.any():
                break
            size = np.diff(np.append(heads, len(at)))
            left = (at[heads] - place[at[heads]])[going] + first[going] % SHORT
            other = after[left]
            follows = after[other]
            symbol[left] = join[left]
            alive[other] = False
            key[other] = key[left] = NEVER
            after[left] = follows
            inner = follows >= 0
            before[follows[inner]] = left[inner]
            again = np.concatenate([left[inner], before[left][before[left] >= 0]])
            key[again], join[again] = self._agenda(symbol[again], symbol[after[again]], place[again])
            keep = np.repeat(going, size) & alive[at]
            heads = np.add.reduceat(keep, heads)[going]
            heads = np.cumsum(heads) - heads
            at = at[keep]
        left = np.flatnonzero(alive)
        ids, lengths = symbol[left], np.ones(len(left), dtype=np.int64)
        odd = np.flatnonzero((ids < 0) | (ids >= len(self.fronted)))
        if len(odd):
            spelled = [[self.bytes[b] for b in characters[n].encode()] for n in left[odd].tolist()]
            lengths[odd] = list(map(len, spelled))
            ids = np.repeat(ids, lengths)
            ids[runs((np.cumsum(lengths) - lengths)[odd], lengths[odd])] = list(chain.from_iterable(spelled))
        total = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(alive)])[np.append(starts, len(symbol))]
        return ids, np.diff(total[bounds])

    @staticmethod
    def _spaced(text: str) -> str:
        """The keys of a text's words, with spaces between: a key that begins with a line feed is its
        word, another one has a mark in front that is left out."""
        if "  " in text or text.startswith(" ") or MARK in text:
            return " ".join(w if w[0] == "\n" else w[1:] for w in _CUT.findall(MARK + text.replace(" ", MARK)))
        return text.replace("\n", " \n")

    def _learn(self) -> None:
        """Merge the words met for the first time and check them by the library."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        fresh_words = [key if key.startswith("\n") else MARK + key for key in fresh]
        sizes = np.fromiter(map(len, fresh_words), dtype=np.int64, count=len(fresh))
        long = np.flatnonzero(sizes > SHORT)
        ids, counts = self.merged_all([w if len(w) <= SHORT else "" for w in fresh_words])
        if len(long):
            spelled = [self.merged(fresh_words[n]) for n in long.tolist()]
            lengths = counts.copy()
            lengths[long] = list(map(len, spelled))
            every = np.empty(int(lengths.sum()), dtype=np.int64)
            starts = np.cumsum(lengths) - lengths
            every[runs(starts, counts)] = ids
            every[runs(starts[long], lengths[long])] = list(chain.from_iterable(spelled))
            ids, counts = every, lengths
        # The library puts a mark before a text; an empty one has no ids, with or without.
        theirs = self.library.encode(fresh, num_threads=1)
        for number, key in enumerate(fresh):
            if not key or key[0] == "\n":
                theirs[number] = theirs[number][1:] if key else [self.pieces[MARK][1]]
        if ids.tolist() != list(chain.from_iterable(theirs)):
            raise ValueError("the library has other ids for a word of this batch")
        self.starts.extend(self.ids.size + np.cumsum(counts) - counts)
        self.lengths.extend(counts)
        self.ids.extend(ids)
        for number in long.tolist():
            del self.numbers[fresh[number]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after the other, and their number by text."""
        if self.numbers.given > CACHED_WORDS or self.ids.size > 16 * CACHED_WORDS:
            self.forget()
        some = [text for text in texts if text]
        words = pc.split_pattern(pa.array(map(self._spaced, some), pa.large_string()), " ")
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[[bool(text) for text in texts]] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        number = self.numbers.__getitem__
        keys = coded.dictionary.to_pylist()
        known = np.fromiter(map(number, keys), dtype=np.int64, count=len(keys))
        self._learn()
        index = known[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths.view()[index]
        return self.ids.view()[runs(self.starts.view()[index], lengths)], _sums(lengths, counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids: surfaces one after the other, without the space the encoder put in front."""
        firsts = np.cumsum(counts) - counts
        some = np.flatnonzero(counts)
        fronted = np.zeros(len(counts), dtype=bool)
        fronted[some] = self.fronted[ids[firsts[some]]]
        raw = self.surfaces.joined(ids, counts)
        return [_as_text(r[1:] if f else r) for r, f in zip(raw, fronted.tolist(), strict=True)]

    def checked_decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """``decode``; raises where the library decodes the same ids to another text."""
        texts = self.decode(ids, counts)
        every, ends = ids.tolist(), np.cumsum(counts).tolist()
        lists = [every[e - n : e] for e, n in zip(ends, counts.tolist(), strict=True)]
        if lists and texts != self.library.decode(lists):
            raise ValueError("the library decodes the ids of this batch to another text")
        return texts

    def in_decimal(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """For each text its ids in decimal, joined by commas."""
        return [joined[:-1] for joined in self.decimals.joined(ids, counts)]


class _Strings:
    """Byte strings by number, to be joined many at a time: they are kept in cells of eight bytes."""

    def __init__(self, strings: list[bytes]) -> None:
        self.length = np.array([len(s) for s in strings], dtype=np.int64)
        self.count = np.maximum(-(-self.length // 8), 1)
        self.start = np.cumsum(self.count) - self.count
        padded = b"".join(s.ljust(8 * n, b"\0") for s, n in zip(strings, self.count.tolist(), strict=True))
        self.cells = np.frombuffer(padded, dtype="<u8")
        filled = b"".join((b"\1" * len(s)).ljust(8 * n, b"\0") for s, n in zip(strings, self.count.tolist(), strict=True))
        self.filled = np.frombuffer(filled, dtype="<u8")

    def joined(self, numbers: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """For each consecutive group of ``counts`` numbers its strings, one after the other."""
        cells = self.count[numbers]
        at = self.start[numbers]
        if len(cells) and cells.max() > 1:
            at = runs(at, cells)
        raw = self.cells[at].view(np.uint8)[self.filled[at].view(bool)].tobytes()
        ends = np.concatenate([[0], np.cumsum(_sums(self.length[numbers], counts))]).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


# Marks, or a line feed, with what follows up to the next of either.
_CUT = re.compile(f"(?:\\n|{MARK}+)[^{MARK}\\n]*")
_MODELS: dict[str, PieceModel] = {}


def _as_text(raw: bytes) -> str:
    """UTF-8 as text; each byte that is no part of a character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError as wrong:
        head, rest = raw[: wrong.start].decode(), raw[wrong.start + 1 :]
        return head + "�" + _as_text(rest)


def model(file: str = MODEL) -> PieceModel:
    """The worker's model; it lives as long as the Python worker."""
    if file not in _MODELS:
        _MODELS[file] = PieceModel(file)
    return _MODELS[file]


def encoded(docs: DataFrame, file: str = MODEL, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs`` (doc_id, text).

    The ids are those of the sentencepiece library for the whole text, without begin or end ids;
    ``with_ids`` adds them as ids (array<int>) and the decoded text as decoded. A null text is empty;
    an empty text has no ids and decodes to an empty one. Null doc_ids and repeated rows are rows like
    any other, an empty table gives no rows, other columns are not looked at. A text of any length is
    one row: a task holds 4 MB of texts at a time, or one longer text, some 30 bytes a character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(file)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = pieces.encode(part.column("text").to_pylist())
                texts = pieces.checked_decode(ids, counts)
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in pieces.in_decimal(ids, counts)], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                }
                if with_ids:
                    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns |= {"ids": pa.ListArray.from_arrays(bounds, ids), "decoded": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, kinds + (", ids array<int>, decoded string" if with_ids else ""))
