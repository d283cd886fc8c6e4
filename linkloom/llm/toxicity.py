"""Toxicity: a lexicon trie met by Levenshtein automata, and scores of the words around each hit.

The lexicon is a short list given as a parameter and the terms of the labelled sample that stand in
toxic texts almost alone: whole words, and stems for words that share a beginning. Trie and automata
are walked together as one automaton whose states are made when a word first needs them; a word leaves
it after a few letters unless it is a term or a misspelled one. Each hit is weighed by its window: in
quotation marks or after a word of reporting it is likely quoted, after a word of address it is meant.
A misspelled term counts as its term at a discount; words that clean labelled texts use do not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.batches import forget, free_name, kept, release, whole_text
from linkloom.llm.learning import TRAIN_ROWS, Logistic, held_out, labelled
from linkloom.llm.shingles import shingle_sets
from linkloom.session import stage

THRESHOLD = 0.7
SEED_TERMS = (
    "asshole", "bastard", "clown", "coward", "cretin", "disgusting", "dumbass", "dimwit", "filthy", "freak", "garbage",
    "idiot", "imbecile", "loser", "lowlife", "maggot", "moron", "pathetic", "pervert", "scum", "scumbag", "sleazy",
    "stupid", "subhuman", "trash", "vermin", "worthless",
)
STEMS = (4, 5, 6)
LEAST_PRECISION = 0.9
MOST_TERMS = 2000
MISSPELLED = 0.6  # of an exact hit
MOST_CHANCE = 100_000
CACHED_WORDS = 100_000
CACHED_LETTERS = 64  # longer words are looked up each time
WINDOW = 6
QUOTES = "\"“”„«»‘’"
REPORTING = frozenset(("called", "calls", "dijo", "dit", "named", "quote", "quoted", "quotes", "said", "sagte", "says", "term", "word", "wrote"))
ADDRESS = frozenset(("du", "ihr", "tu", "usted", "vous", "you", "your", "youre"))
_WORD = re.compile(r"[^\W_]+")


class Term(NamedTuple):
    text: str
    stem: bool
    weight: float

    @property
    def edits(self) -> int:
        """How many letters may be wrong; stems and short words are taken as they are."""
        return 0 if self.stem or len(self.text) < 5 else 1 if len(self.text) < 10 else 2


class FuzzyLexicon:
    """Levenshtein automata of all terms, intersected with their trie; states are made when needed.

    A state holds trie nodes with the fewest edits they are reached with.
    """

    def __init__(self, terms: Sequence[Term]) -> None:
        self.terms = list(terms)
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.most: list[int] = [0]
        for number, term in enumerate(self.terms):
            node = 0
            self.most[0] = max(self.most[0], term.edits)
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], term.edits)
            (self.stem_at if term.stem else self.word_at).setdefault(node, number)
        self.states: dict[frozenset, int] = {}
        self.members: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.word_hits: list[tuple[int, int] | None] = []
        self.stem_hits: list[tuple[int, int] | None] = []
        self.dead = self._state({})
        self.first = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        todo = list(reached.items())
        while todo:  # a letter of the term is missing in the word
            node, edits = todo.pop()
            if reached.get(node) != edits:
                continue
            for child in self.children[node].values():
                if edits < self.most[child] and reached.get(child, 9) > edits + 1:
                    reached[child] = edits + 1
                    todo.append((child, edits + 1))
        key = frozenset(reached.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(reached)
            self.steps.append({})
            self.word_hits.append(self._best(reached, self.word_at))
            self.stem_hits.append(self._best(reached, self.stem_at))
        return self.states[key]

    def _best(self, reached: dict[int, int], ends: dict[int, int]) -> tuple[int, int] | None:
        """Term and edits of the best term that ends here: fewest edits, longest, first listed."""
        found = [
            (edits, -len(self.terms[ends[node]].text), ends[node])
            for node, edits in reached.items()
            if node in ends and edits <= self.terms[ends[node]].edits
        ]
        return (min(found)[2], min(found)[0]) if found else None

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self.members[state].items():
            for own, child in self.children[node].items():
                cost = edits + (own != letter)
                if cost <= self.most[child] and reached.get(child, 9) > cost:
                    reached[child] = cost
            if edits < self.most[node] and reached.get(node, 9) > edits + 1:
                reached[node] = edits + 1  # the word has a letter more
        return self._state(reached)

    def find(self, word: str) -> tuple[int, int] | None:
        """The term a word stands for and the number of wrong letters; words come in lower case."""
        state, stem = self.first, None
        for letter in word:
            after = self.steps[state].get(letter)
            if after is None:
                after = self.steps[state][letter] = self._step(state, letter)
            state = after
            if state == self.dead:
                return stem
            if stem is None:
                stem = self.stem_hits[state]
        whole = self.word_hits[state]
        if whole is None or (stem is not None and stem[1] < whole[1]):
            return stem
        return whole


class Detector:
    """Features of texts from a lexicon. Keeps what it found for a bounded number of words.

    Words of ``chance`` resemble terms by chance and are no misspelled ones.
    """

    names = ("hits", "strongest", "share", "quoted")

    def __init__(self, terms: Sequence[Term], chance: frozenset[str] = frozenset()) -> None:
        self.lexicon = FuzzyLexicon(terms)
        self.chance = chance
        self.known: dict[str, tuple[int, int] | None] = {}

    def _find(self, word: str) -> tuple[int, int] | None:
        found = self.lexicon.find(word)
        return None if found and found[1] and word in self.chance else found

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, int, float]], int]:
        """(begin, end, term, edits, context) of every hit, and the number of words."""
        lowered = text.lower()
        words = _WORD.findall(lowered)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        long = {}
        for word in set(words).difference(known):
            (known if len(word) <= CACHED_LETTERS else long)[word] = self._find(word)
        if not any(map(known.get, words)) and not any(long.values()):
            return [], len(words)
        spans = [m.span() for m in _WORD.finditer(lowered)]
        out = []
        for i, word in enumerate(words):
            found = known[word] if word in known else long[word]
            if found is None:
                continue
            before = lowered[spans[max(0, i - WINDOW)][0] : spans[i][0]]
            after = lowered[spans[i][1] : spans[min(len(words) - 1, i + WINDOW)][1]]
            out.append((*spans[i], *found, context(before, after, words[max(0, i - WINDOW) : i])))
        return out, len(words)

    def features(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.names)))
        for row, text in enumerate(texts):
            found, n = self.hits(text)
            if not found:
                continue
            counted = [c * (MISSPELLED if e else 1) for _, _, _, e, c in found]
            out[row] = (
                np.log1p(sum(counted)),
                max(self.lexicon.terms[t].weight * k for (_, _, t, _, _), k in zip(found, counted, strict=True)),
                np.log1p(100 * sum(counted) / n),
                sum(c < 1 for _, _, _, _, c in found) / len(found),
            )
        return out


def context(before: str, after: str, words_before: Sequence[str]) -> float:
    """How much a hit is meant: lower in quotation marks and after reporting words, higher in address."""
    opened = sum(before.count(q) for q in QUOTES)
    closed = sum(after.count(q) for q in QUOTES)
    score = 1.0
    if opened % 2 and closed:
        score -= 0.4
    if REPORTING.intersection(words_before[-3:]):
        score -= 0.2
    if ADDRESS.intersection(words_before[-3:]):
        score += 0.2
    return score


def _stems(letters: int) -> Column:
    """Distinct beginnings of the longer words, written with a star."""

    def cut(word: Column) -> Column:
        return F.concat(F.left(word, F.lit(letters)), F.lit("*"))

    return F.array_distinct(F.transform(F.filter("words", lambda w: F.length(w) > letters), cut))


def learned_terms(sample: DataFrame) -> list[Term]:
    """Words and stems that stand in toxic texts of the sample almost alone.

    Of texts that share their smallest shingle, so of most near copies, one counts. The number of
    texts is bounded by the sample, and so are the counts that reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sets = shingle_sets(batch.column("text"), 4)
            least = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            words = [sorted(set(_WORD.findall(t.lower()))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"least": pa.array(least, pa.int64()), "label": batch.column("label"), "words": pa.array(words, pa.list_(pa.string()))}
            )

    told = sample.select("text", "label").mapInArrow(run, "least long, label int, words array<string>")
    told = stage(told.dropDuplicates(["least", "label"]))
    total, toxic = told.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    forms = F.col("words")
    for n in STEMS:
        forms = F.concat(forms, _stems(n))
    counts = told.select(F.explode(forms).alias("term"), "label").groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")
    )
    # so many toxic texts and hardly a clean one are not had by chance for any of the terms tried
    counts = stage(counts)
    share = min(max(toxic / max(total, 1), 1e-3), 0.5)
    support = max(3, int(np.ceil((np.log(max(counts.count(), 1)) + 3) / -np.log(share))))
    good = counts.where((F.col("toxic") >= support) & (F.col("toxic") >= LEAST_PRECISION * F.col("n")) & (F.length("term") >= 4))
    rows = good.orderBy(F.col("toxic").desc(), F.length("term"), "term").limit(MOST_TERMS).collect()
    prior = np.log((toxic + 1) / (total - toxic + 1))
    found: list[Term] = []
    for row in rows:
        weight = float(np.log((row.toxic + 0.5) / (row.n - row.toxic + 0.5)) - prior)
        stem = row.term.endswith("*")
        text = row.term.rstrip("*")
        # a word below a stem stays if it may be misspelled, as stems are taken as they are
        covered = any(text.startswith(t.text) if t.stem else text == t.text for t in found)
        covered = covered and (stem or Term(text, False, weight).edits == 0)
        # a stem that finds hardly more than one of its words is left to the word
        own = max((r.toxic for r in rows if not r.term.endswith("*") and r.term.startswith(text)), default=0) if stem else 0
        if not covered and not (stem and row.toxic <= 1.2 * own):
            found.append(Term(text, stem, weight))
    return found


def chance_neighbours(sample: DataFrame, terms: Sequence[Term]) -> frozenset[str]:
    """Words that pass for misspelled terms but stand in clean texts of the sample, the most frequent of them.

    As with terms, a clean text among many toxic ones does not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _detector(terms).lexicon
        for batch in batches:
            words = [sorted(set(_WORD.findall(t.lower()))) for t in batch.column("text").to_pylist()]
            known = {w: lexicon.find(w) for w in set().union(*words)}
            words = [[w for w in row if known[w] and known[w][1]] for row in words]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "words": pa.array(words, pa.list_(pa.string()))})

    told = sample.select("text", "label").mapInArrow(run, "label int, words array<string>")
    told = told.select(F.explode("words").alias("word"), "label").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")
    )
    told = told.where(F.col("toxic") < LEAST_PRECISION * F.col("n"))
    return frozenset(r.word for r in told.orderBy(F.col("n").desc(), "word").limit(MOST_CHANCE).collect())


class Model(NamedTuple):
    terms: list[Term]
    regression: Logistic
    chance: frozenset[str] = frozenset()


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights from at most ``most`` labelled rows that are not held out."""
    sample = stage(labelled(docs, labels, "toxic", most))
    terms = learned_terms(sample)
    typical = float(np.median([t.weight for t in terms])) if terms else 3.0
    have = {t.text for t in terms if not t.stem}
    terms += [Term(w, False, typical) for w in SEED_TERMS if w not in have]
    chance = chance_neighbours(sample, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(terms, chance)
        for batch in batches:
            x = detector.features(batch.column("text").to_pylist())
            columns = {n: pa.array(x[:, i]) for i, n in enumerate(Detector.names)}
            yield pa.RecordBatch.from_pydict({**columns, "label": batch.column("label")})

    kinds = ", ".join(f"{n} double" for n in Detector.names)
    rows = sample.mapInArrow(run, f"{kinds}, label int").toPandas()
    x, y = rows[list(Detector.names)].to_numpy(), rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():  # nothing to learn from: a strong hit or three misspelled ones are enough
        few, many = MISSPELLED, 3 * MISSPELLED
        clean = [(np.log1p(few), few * typical, share, 0) for share in (1, 4)]
        bad = [(np.log1p(n), w * typical, share, 0) for n, w in ((1, 1), (many, few)) for share in (1, 4)]
        x = np.vstack([np.zeros((8, len(Detector.names))), clean, bad])
        y = np.array([0.0] * 10 + [1.0] * 4)
    return Model(terms, Logistic(x, y, ridge=0.03), chance)


def _detector(terms: Sequence[Term], chance: frozenset[str] = frozenset()) -> Detector:
    return kept("detector", (tuple(terms), chance), lambda: Detector(terms, chance), alone=True)


def score(model: Model, text: Column) -> Column:
    """Toxicity of a text, 0 to 1; null texts score as empty ones."""
    terms, regression, chance = model

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        found = pd.Series(regression.probability(_detector(terms, chance).features(texts.fillna("").tolist())))
        release()
        return found

    return scored(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Every whole text is scored, from its words alone. Null and empty texts get the score of a text
    without hits. Repeated rows are scored each; an empty table gives no rows; without usable labels
    the given terms alone decide. Other columns are not looked at.
    """
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    told = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that score below the threshold. Nothing is shuffled."""
    model = fit(docs, labels)
    name = free_name(docs, "toxicity")
    return docs.withColumn(name, score(model, whole_text())).where(F.col(name) < THRESHOLD).drop(name)


def spans(docs: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """doc_id, begin, end, term, edits and context of every hit, in code points of the lower-cased text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = _detector(terms)
        for batch in batches:
            rows = [
                (key, begin, end, terms[t].text, edits, c)
                for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for begin, end, t, edits, c in detector.hits(text)[0]
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64())
            names = ("doc_id", "begin", "end", "term", "edits", "context")
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, begin long, end long, term string, edits int, context double")
