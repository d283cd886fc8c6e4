"""URL lists and file tables as import input."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed
from linkloom.functions.urls import normalize_urls


def listed_urls(
    urls: DataFrame,
    url: str,
    source_name: Column | str,
    label: str = "harvest",
    source_id: Column | int = 1,
    position: str = "position",
    seen_at: Column | None = None,
) -> DataFrame:
    """Occurrences of an already discovered URL list: its own source, row = place in the list."""
    name = source_name if isinstance(source_name, Column) else F.lit(source_name)
    number = source_id if isinstance(source_id, Column) else F.lit(source_id)
    records = urls.select(
        number.cast("long").alias("source_id"),
        name.alias("source_file"),
        F.col(position).cast("long").alias("source_row"),
        F.lit(0).alias("col_idx"),
        F.lit(label).alias("source_column"),
        (F.lit(None).cast("timestamp_ntz") if seen_at is None else seen_at).alias("seen_at"),
        F.lit(0).alias("match_idx"),
        F.col(url).alias("raw_url"),
    )
    return normalize_urls(records)


def short_name(name: Column) -> Column:
    """A source name as it is stored for lists."""
    return F.left(name, F.lit(fixed.SOURCE_NAME_LENGTH))


def new_files(files: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Files to import: the first of every (hash, size), unless that content is complete already.

    The copies of one content are reduced by an aggregate, which combines on the map side.
    """
    others = [c for c in files.columns if c not in ("file_hash", "file_size")]
    rest = [c for c in others if c not in order]
    first = files.groupBy("file_hash", "file_size").agg(F.min(F.struct(*order, *rest)).alias("first"))
    done = known.where(F.col("status") == "complete").select("file_hash", "file_size")
    return (
        first.select("file_hash", "file_size", "first.*")
        .join(done, ["file_hash", "file_size"], "left_anti")
        .select(*files.columns)
    )

