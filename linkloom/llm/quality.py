"""Quality: evidence of the text, and of the site and path it comes from, by hierarchical empirical Bayes.

A logistic regression on shares of the text's characters and words gives each document's evidence.
Sites (host) and paths below them get posterior means of their documents' probabilities: a path is
drawn towards its host, a host towards the corpus, the more so the fewer documents it has. How strongly
is estimated from the spread between hosts, and between the paths of a host. The document's log odds
then move by a share of how its path differs from the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.batches import free_name, slices, whole_text
from linkloom.llm.learning import TRAIN_ROWS, Logistic, labelled
from linkloom.llm.shingles import word_hashes

KEEP = 0.5
SITE_SHARE = 0.5
CLASSES = ("upper", "lower", "digit", "mark", "stop", "space", "line")
NAMES = ("size", "upper", "digit", "mark", "stop", "line", "word_length", "distinct", "distinct_low", "upper_high", "mark_high")
BROADCAST_SITES = 50_000
HOST, PATH = "source", "lang"
SLICE = 1 << 20  # bytes of text whose features are worked out at once; some hundred bytes a byte are needed


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), dtype=np.uint8)
    for byte in range(128):
        c = chr(byte)
        kind = (
            "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "line" if c == "\n"
            else "space" if c.isspace() else "stop" if c in ".,;:?'-" else "mark" if c.isprintable() else None
        )
        if kind:
            table[byte] = CLASSES.index(kind)
    return table


_TABLE = _class_table()


def features(texts: pa.Array) -> np.ndarray:
    """Shares of characters and words, from the texts' UTF-8 bytes."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    sizes = np.diff(offsets)
    counts = np.zeros((len(texts), len(CLASSES)))
    if len(texts) and offsets[-1] > offsets[0]:
        kinds = _TABLE[np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
        row = np.repeat(np.arange(len(texts)), sizes)
        flat = np.bincount(row * (len(CLASSES) + 1) + kinds, minlength=len(texts) * (len(CLASSES) + 1))
        counts = flat.reshape(len(texts), -1)[:, : len(CLASSES)].astype(float)
    hashes, words = word_hashes(texts)
    ends = np.cumsum(words)
    distinct = np.array([len(np.unique(hashes[e - n : e])) for e, n in zip(ends.tolist(), words.tolist(), strict=True)], dtype=float)
    by = dict(zip(CLASSES, counts.T, strict=True))
    n, w = np.maximum(sizes, 1), np.maximum(words, 1)
    # few words repeat in a short text and many in a long one: compare with the usual number
    fresh = distinct / np.maximum(w**0.93, 1)
    upper, mark = by["upper"] / n, by["mark"] / n
    return np.column_stack(
        [
            np.log1p(sizes), upper, by["digit"] / n, mark, by["stop"] / n, by["line"] / w, np.minimum(n / w, 40),
            fresh, np.maximum(0.6 - fresh, 0), np.minimum(np.maximum(upper - 0.1, 0), 0.2), np.minimum(np.maximum(mark - 0.02, 0), 0.05),
        ]
    )


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Logistic:
    """Weights from at most ``most`` labelled rows that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = features(part.column("text"))
                columns = {n: pa.array(x[:, i], pa.float64()) for i, n in enumerate(NAMES)}
                yield pa.RecordBatch.from_pydict({**columns, "label": part.column("label")})

    kinds = ", ".join(f"{n} double" for n in NAMES)
    rows = labelled(docs, labels, "quality", most).mapInArrow(run, f"{kinds}, label int").toPandas()
    x, y = rows[list(NAMES)].to_numpy(), rows["label"].to_numpy(float)
    if not len(y):  # nothing is known: keep everything
        x, y = np.zeros((2, len(NAMES))), np.ones(2)
    return Logistic(x, y)


def evidence(model: Logistic, text: Column) -> Column:
    """The text's log odds of good quality."""

    @F.pandas_udf("double")
    def told(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_pydict({"text": pa.array(texts.fillna("").tolist(), pa.string())})
        parts = [model.logit(features(p.column("text"))) for p in slices(batch, "text", SLICE)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0)).clip(-12, 12)

    return told(text)


class Priors(NamedTuple):
    """Corpus mean, and how many documents' weight it has for a host, and a host's mean for a path."""

    mean: float
    host_weight: float
    path_weight: float


def _weight(mean: float, within: float, between: float) -> float:
    """Documents a prior counts for: the spread inside a group against that between groups."""
    del mean
    return float(np.clip(within / between, 1.0, 1e6)) if between > 0 else 1e6


def site_posteriors(sites: DataFrame) -> tuple[DataFrame, Priors]:
    """host, path and posterior of every path, from documents' probabilities by host and path.

    ``sites``: host, path, n, total, squares. The variance between groups is what their means vary
    more than documents inside them explain.
    """
    hosts = sites.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("total").alias("ht"))

    def moments(groups: DataFrame, count: str, total: str) -> tuple[float, float]:
        m = F.col(total) / F.col(count)
        row = groups.agg(F.sum(count), F.sum(total), F.sum(m * m * F.col(count)), F.count(F.lit(1))).first()
        if not row[0]:
            return 0.0, 0.0
        mean = row[1] / row[0]
        return mean, max(row[2] / row[0] - mean**2, 0.0)

    everything = sites.agg(F.sum("n"), F.sum("total"), F.sum("squares"), F.count(F.lit(1)), F.count_distinct("host")).first()
    n = everything[0] or 0
    mean, host_spread = moments(hosts, "hn", "ht")
    _, path_spread = moments(sites, "n", "total")
    variance = max((everything[2] or 0) / n - mean**2, 1e-9) if n else 1e-9
    within = max(variance - path_spread, 1e-9)
    noise = lambda groups: within * (groups or 0) / max(n, 1)  # noqa: E731  means vary by this alone
    priors = Priors(
        mean,
        _weight(mean, within, host_spread - noise(everything[4])),
        _weight(mean, within, path_spread - host_spread - noise((everything[3] or 0) - (everything[4] or 0))),
    )
    host_mean = (F.col("ht") + priors.host_weight * priors.mean) / (F.col("hn") + priors.host_weight)
    joined = sites.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    posterior = (F.col("total") + priors.path_weight * host_mean) / (F.col("n") + priors.path_weight)
    return joined.select("host", "path", posterior.alias("posterior")), priors


def _logit(p: Column) -> Column:
    kept = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(kept / (1 - kept))


def _judged(docs: DataFrame, labels: DataFrame, kept: Sequence[str], own: str, site: str, host: str, path: str) -> DataFrame:
    """The columns ``kept`` with log odds ``own`` and the site's posterior ``site``.

    Hosts and paths are summed up where the documents are, so a host with a third of all rows is one
    row of each task. The posteriors go to the documents while there are at most BROADCAST_SITES paths;
    more are joined by a shuffle, in which a large host is split.
    """
    model = fit(docs, labels)
    told = docs.select(*kept, evidence(model, whole_text()).alias(own))
    p = 1 / (1 + F.exp(-F.col(own)))
    summed = told.select(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), p.alias("p"))
    summed = summed.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")
    )
    from linkloom.session import stage

    posteriors, priors = site_posteriors(stage(summed))
    posteriors = stage(posteriors.select(F.col("host").alias(f"{site}_host"), F.col("path").alias(f"{site}_path"), F.col("posterior").alias(f"{site}_p")))
    if posteriors.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        posteriors = F.broadcast(posteriors)
    same = told[host].cast("string").eqNullSafe(F.col(f"{site}_host")) & told[path].cast("string").eqNullSafe(F.col(f"{site}_path"))
    joined = told.join(posteriors, same, "left").drop(f"{site}_host", f"{site}_path")
    shift = SITE_SHARE * (_logit(F.col(f"{site}_p")) - _logit(F.lit(priors.mean)))
    return joined.withColumn(site, F.col(own) + shift).drop(f"{site}_p")


def judged(docs: DataFrame, labels: DataFrame, host: str = HOST, path: str = PATH) -> DataFrame:
    """doc_id, evidence, score and keep (0 or 1) of every document.

    score is the posterior probability of good quality, keep is score >= KEEP. Null and empty texts
    have the evidence of an empty text; a null host or path is a site of its own. Repeated rows are
    judged each; an empty table gives no rows; without labels everything is kept. Other columns are
    not looked at.
    """
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"), whole_text().alias("text"))
    told = _judged(told, labels, ["doc_id", "host", "path"], "own", "odds", "host", "path")
    score = 1 / (1 + F.exp(-F.col("odds")))
    return told.select(
        "doc_id", (1 / (1 + F.exp(-F.col("own")))).alias("evidence"), score.alias("score"), (score >= KEEP).cast("int").alias("keep")
    )


def without_poor(docs: DataFrame, labels: DataFrame, host: str = HOST, path: str = PATH) -> DataFrame:
    """The documents, all columns, whose posterior probability of good quality is at least KEEP."""
    own, site = free_name(docs, "own_odds"), free_name(docs, "site_odds")
    told = _judged(docs, labels, docs.columns, own, site, host, path)
    return told.where(1 / (1 + F.exp(-F.col(site))) >= KEEP).select(*docs.columns)
