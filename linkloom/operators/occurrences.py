"""From text records to occurrences: one row per URL found, in reading order."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from linkloom.functions import fixed
from linkloom.functions.extract import extract_urls
from linkloom.functions.urls import normalize_urls

# The order in which occurrences are met; every "first one wins" rule follows it.
READING_ORDER = ("source_id", "source_row", "col_idx", "match_idx")


def occurrences(
    records: DataFrame,
    schemes: Sequence[str] = fixed.DEFAULT_SCHEMES,
    international_hosts: bool = True,
    parts: bool = True,
) -> DataFrame:
    """Extract and normalise the URLs of text records.

    ``records`` has source_id, source_file, source_row, col_idx, source_column, seen_at and text. Without
    ``parts`` URLs are normalised but their parts are not told.
    """
    return normalize_urls(
        extract_urls(records),
        schemes=schemes,
        international_hosts=international_hosts,
        trimmed=True,
        parts=parts,
    )
