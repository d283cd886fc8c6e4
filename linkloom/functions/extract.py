"""Finding URLs in text (column expressions, all JVM side)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed
from linkloom.functions.barrier import bind, computed_once


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


# Read from the right, every punctuation character of a match goes until a ")" is met that has a
# partner. So of the closing parentheses in the trailing run as many stay as still find an opening
# one, with everything before the last of them.
def _base(url: Column) -> Column:
    return F.rtrim(url, F.lit(fixed.TRAILING_PUNCTUATION))


def _run(url: Column, base: Column) -> Column:
    return F.substring(url, F.length(base) + 1, F.lit(fixed.TO_THE_END))


def _kept(base: Column, run: Column) -> Column:
    balance = F.least(_count(base, "(") - _count(base, ")"), _count(run, ")"))
    return F.when(run == "", 0).otherwise(balance)


def _stripped(base: Column, run: Column, kept: Column) -> Column:
    """A slash after a closing parenthesis goes as well."""
    up_to_kept = F.call_function("substring_index", run, F.lit(")"), kept)
    return (
        F.when(kept > 0, F.concat(base, up_to_kept, F.lit(")")))
        .when(F.endswith(base, F.lit(")/")), F.left(base, F.length(base) - 1))
        .otherwise(base)
    )


def strip_punctuation(url: Column) -> Column:
    """A URL match without prose punctuation at its end, balanced parentheses kept."""
    return bind(
        _base(url),
        lambda base: bind(
            _run(url, base), lambda run: _stripped(base, run, _kept(base, run))
        ),
    )


def with_stripped(df: DataFrame, match: str, name: str) -> DataFrame:
    """``strip_punctuation`` of a column as projections, which run as generated code."""
    url, base, run = F.col(match), F.col("base"), F.col("run")
    return (
        df.withColumn("base", _base(url))
        .withColumn("run", _run(url, base))
        .withColumn("kept", _kept(base, run))
        .withColumn(name, _stripped(base, run, F.col("kept")))
        .drop("base", "run", "kept")
    )


def url_matches(text: Column) -> Column:
    """All URL matches of a text in order, before punctuation is stripped."""
    return F.regexp_extract_all(text, F.lit(fixed.URL_PATTERN), F.lit(1))


def explode_matches(df: DataFrame, kept: list[str], matches: Column) -> DataFrame:
    """One row per match: the kept columns, ``match_idx`` and ``raw_url``."""
    exploded = df.select(*kept, F.posexplode(matches).alias("match_idx", "match"))
    stripped = with_stripped(exploded.withColumn("match_idx", F.col("match_idx").cast("long")), "match", "stripped")
    return computed_once(
        stripped, [*kept, "match_idx"], [F.col("stripped").alias("raw_url")]
    ).where(F.length("raw_url") <= fixed.MAX_URL_LENGTH)


def extract_urls(records: DataFrame, text: str = "text") -> DataFrame:
    """One row per URL in ``text``: the other columns, ``match_idx`` and ``raw_url``.

    ``contains`` is a cheap byte search that spares texts without any URL the regular expression.
    """
    kept = [c for c in records.columns if c != text]
    return explode_matches(
        records.where(F.contains(text, F.lit("://"))), kept, url_matches(F.col(text))
    )
