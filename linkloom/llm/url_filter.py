"""URL filters: all glob rules at once, as bits of a few machine words.

A rule is a glob over the canonical URL, host and path. ``?`` is one byte, ``*`` a run of bytes without
``/``, ``**`` any run, everything else itself. Each rule has one bit per literal or ``?`` and one for its
start; the rules lie side by side in as many 64-bit words as they need. Reading a byte shifts all words
by one, ANDs them with the byte's mask of accepting bits, and keeps the bits of stars that may repeat.
A block of URLs is read column by column, longest first, so every step is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.batches import slices

_ONE = np.uint64(1)
_TOP = np.uint64(63)


class SiteRule(NamedTuple):
    """A host with all its subdomains, below a path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        return f"{self.name}**", f"*.{self.name}**"


SITE_RULES = (
    SiteRule("com", "/", "allow"),
    SiteRule("example.com", "/en/", "block"),
    SiteRule("www.example.com", "/en/", "allow"),
    SiteRule("net", "/es/", "block"),
    SiteRule("net", "/fr/", "block"),
)
# Hosts that no site rule speaks for are blocked if one of these fits, else allowed.
BLOCKED_GLOBS = (
    "*adult-*", "*adult-*/**", "*casino*", "*casino*/**", "*cheap-pills*", "*cheap-pills*/**",
    "**/wp-login.php", "**/cgi-bin/**", "**.exe",
)


def _elements(glob: str) -> list[bytes]:
    """Literal bytes, ``?``, ``*`` and ``**`` of a glob."""
    out: list[bytes] = []
    at, raw = 0, glob.encode()
    while at < len(raw):
        step = 2 if raw[at : at + 2] == b"**" else 1
        out.append(raw[at : at + step])
        at += step
    return out


class GlobAutomaton:
    """Multiword Shift-And over any number of globs."""

    def __init__(self, globs: Sequence[str]) -> None:
        parsed = [_elements(g) for g in globs]
        bits = sum(1 + sum(e not in (b"*", b"**") for e in elements) for elements in parsed)
        self.n_words = max(1, -(-bits // 64))
        self.accepts = np.zeros((256, self.n_words), dtype=np.uint64)
        self.repeats = np.zeros((256, self.n_words), dtype=np.uint64)
        self.start = np.zeros(self.n_words, dtype=np.uint64)
        self.finals: list[tuple[int, np.uint64]] = []
        slash = np.arange(256) != ord("/")
        bit = 0
        for elements in parsed:
            self.start[bit // 64] |= _ONE << np.uint64(bit % 64)
            for element in elements:
                if element in (b"*", b"**"):
                    own = _ONE << np.uint64(bit % 64)
                    rows = slash if element == b"*" else slice(None)
                    self.repeats[rows, bit // 64] |= own
                    continue
                bit += 1
                rows = slice(None) if element == b"?" else element[0]
                self.accepts[rows, bit // 64] |= _ONE << np.uint64(bit % 64)
            self.finals.append((bit // 64, np.uint64(bit % 64)))
            bit += 1

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """For every text and glob, does the glob fit the whole text."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        at = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        live = len(texts)
        for column in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes[:live], -column, side="left"))
            byte = flat[at[:live] + column]
            now = state[:live]
            moved = now << _ONE
            moved[:, 1:] |= now[:, :-1] >> _TOP
            state[:live] = (moved & self.accepts[byte]) | (now & self.repeats[byte])
        out = np.empty((len(texts), len(self.finals)), dtype=bool)
        for rule, (word, bit) in enumerate(self.finals):
            out[order, rule] = (state[:, word] >> bit) & _ONE != 0
        return out


def url_host(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def judged(
    urls: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[SiteRule] = SITE_RULES,
    blocked: Sequence[str] = BLOCKED_GLOBS,
) -> DataFrame:
    """key, host, path, rule and verdict of every URL.

    The longest site rule that fits decides; equal lengths, the first listed. Without one, the URL is
    blocked if a glob of ``blocked`` fits it. Null URLs and those without ``://`` have empty host and
    path and are judged like any other: no site rule fits them. Repeated rows are judged each; an
    empty table gives no rows; other columns are not looked at, whatever their names. There is no
    join and no shuffle: the rules are part of the program and every URL is read once.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [g for r in ranked for g in r.globs()] + list(blocked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(globs)
        names = np.array([r.name for r in ranked] + [None], dtype=object)
        verdicts = np.array([r.verdict for r in ranked], dtype=object)
        for batch in batches:
            for part in slices(batch, "path", 1 << 20):
                hosts, paths = part.column("host").to_pylist(), part.column("path").to_pylist()
                fits = automaton.matches([(h + p).encode() for h, p in zip(hosts, paths, strict=True)])
                site = fits[:, : 2 * len(ranked)].reshape(len(hosts), len(ranked), 2).any(axis=2)
                site = np.concatenate([site, np.ones((len(hosts), 1), dtype=bool)], axis=1)
                first = site.argmax(axis=1)
                bad = fits[:, 2 * len(ranked) :].any(axis=1)
                own = np.append(verdicts, None)[first]
                verdict = np.where(first < len(ranked), own, np.where(bad, "block", "allow"))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": part.column("key"),
                        "host": part.column("host"),
                        "path": part.column("path"),
                        "rule": pa.array(names[first].tolist(), pa.string()),
                        "verdict": pa.array(verdict.tolist(), pa.string()),
                    }
                )

    rows = urls.select(F.col(key).alias("key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string")
    return found.withColumnRenamed("key", key)
