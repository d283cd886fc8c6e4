"""Public suffix rules as a table."""

import functools
from collections.abc import Iterable
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_FILE = "public_suffix_rules.txt"


@functools.cache
def _own_lines() -> tuple[str, ...]:
    """The public section of the list, which comes with the package."""
    return tuple(resources.files(__package__).joinpath(RULE_FILE).read_text("utf-8").splitlines())


def _ascii(rule: str) -> str:
    """A rule in the form host names are stored in."""
    if rule.isascii():
        return rule
    import idna

    return idna.encode(rule).decode("ascii")


def suffix_rules(spark: SparkSession, lines: Iterable[str] | None = None) -> DataFrame:
    """One row per suffix text: is it a rule, the parent of a ``*.`` rule, a ``!`` exception.

    ``lines`` may hold a newer list in the same format. A list has some ten thousand rules, so
    the table is local and small enough to broadcast.
    """
    kinds: dict[str, set[str]] = {}
    for line in _own_lines() if lines is None else lines:
        rule = line.strip().lower()
        if not rule or rule.startswith("//"):
            continue
        if rule.startswith("*."):
            kinds.setdefault(_ascii(rule[2:]), set()).add("wildcard")
        elif rule.startswith("!"):
            kinds.setdefault(_ascii(rule[1:]), set()).add("exception")
        else:
            kinds.setdefault(_ascii(rule), set()).add("rule")
    table = pa.table(
        {
            "suffix": pa.array(list(kinds), pa.string()),
            "is_rule": ["rule" in k for k in kinds.values()],
            "is_wildcard": ["wildcard" in k for k in kinds.values()],
            "is_exception": ["exception" in k for k in kinds.values()],
        }
    )
    return spark.createDataFrame(table).select(
        F.col("suffix"), F.col("is_rule"), F.col("is_wildcard"), F.col("is_exception")
    )


def longest_rule(rules: DataFrame) -> int:
    """Labels of the longest rule; a wildcard stands for one more."""
    labels = F.size(F.split("suffix", r"\.")) + F.col("is_wildcard").cast("int")
    return rules.agg(F.coalesce(F.max(labels), F.lit(0))).first()[0]


@functools.cache
def own_longest() -> int:
    """The same of the package's own list, without a job."""
    return max(line.strip().count(".") + 1 for line in _own_lines() if line and not line.startswith("//"))
