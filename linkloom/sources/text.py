"""URLs of plain text files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.extract import explode_matches, url_matches
from linkloom.sources.files import read_lines, with_line_numbers
from linkloom.session import stage


def scan_text(spark: SparkSession, paths: list[str] | str, only_other_than_csv: bool = False) -> DataFrame:
    """path, source_row (line number), match_idx and raw_url for every URL of text files.

    Lines are written down once with their matches instead of their text, which gives them stable
    positions for little space; the text is read a single time.
    """
    lines = read_lines(spark, paths, suffix_csv=False if only_other_than_csv else None)
    matched = lines.select(
        "path",
        "block_start",
        "spot",
        F.when(F.contains("text", F.lit("://")), url_matches(F.col("text"))).alias("matches"),
    )
    numbered = with_line_numbers(stage(matched))
    return explode_matches(
        numbered.select("path", F.col("line_no").alias("source_row"), "matches"),
        ["path", "source_row"],
        F.col("matches"),
    )
