"""Small predicates and clean-ups on text columns."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import fixed


def sql_like(text: Column, pattern: str) -> Column:
    """LIKE that ignores ASCII case only; ``%`` and ``_`` are wildcards, nothing escapes them.

    ``ilike`` would fold other letters as well. Java's case-insensitive matching is ASCII only, and
    outer ``%`` need no matching at all.
    """
    core = pattern.strip("%")
    pieces = [p for p in re.split(r"([%_])", core) if p]
    body = "".join({"%": ".*", "_": "."}.get(p) or r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E" for p in pieces)
    front = "" if pattern.startswith("%") else r"\A"
    back = "" if pattern.endswith("%") else r"\z"
    return text.rlike(f"(?is){front}{body}{back}")


def contains_text(text: Column, query: str) -> Column:
    """The search box: the query anywhere in the text."""
    return sql_like(text, f"%{query}%")


def has_extension(path: Column, extension: str) -> Column:
    """Whether a path ends in the extension, which may hold the wildcards of LIKE."""
    dotted = extension if extension.startswith(".") else f".{extension}"
    return sql_like(F.lower(path), f"%{dotted.lower()}")


def before(moment: Column, until: str) -> Column:
    """Whether a time, written YYYY-MM-DDTHH:MM:SSZ, sorts up to ``until`` as text.

    A shorter text sorts before every time it begins, so a plain date leaves its own day out.
    """
    limit = F.lit(_as_time(until)).cast("timestamp_ntz")
    return moment <= limit if len(until) >= len("2000-01-01T00:00:00Z") else moment < limit


def since(moment: Column, start: str) -> Column:
    return moment >= F.lit(_as_time(start)).cast("timestamp_ntz")


def _as_time(text: str) -> str:
    """The first second a (possibly shortened) time stands for."""
    lowest = "0001-01-01T00:00:00"
    text = text.rstrip("Zz").replace(" ", "T")
    return (text + lowest[len(text) :])[: len(lowest)]


def iso_time(moment: Column) -> Column:
    """The written form of a time in exports."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def safe_directory(name: Column) -> Column:
    """A host name as a folder name."""
    cleaned = F.ltrim(F.regexp_replace(name, r"[^\p{L}\p{N}._\-]", "_"), F.lit("."))
    return F.when(F.coalesce(cleaned, F.lit("")) == "", "unknown").otherwise(cleaned)


def known_priority(priority: Column) -> Column:
    return F.when(priority.isin(*fixed.PRIORITIES), priority).otherwise("NORMAL")


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "HIGH", 0).when(priority == "NORMAL", 1).otherwise(2)
