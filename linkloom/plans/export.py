"""Writing links to files."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from linkloom.functions.text import iso_time, safe_directory
from linkloom.operators.links import with_url_parts
from linkloom.operators.search import of_domain
from linkloom.plans.library import Library
from linkloom.session import stage

ALL_COLUMNS = (
    "normalized_url",
    "original_url",
    "scheme",
    "hostname",
    "registered_domain",
    "path",
    "query",
    "first_seen",
    "source_file",
)
EXPORT_ORDER = ("hostname", "normalized_url")
DOMAIN_COLUMNS = ("normalized_url", "original_url", "scheme", "path", "query", "first_seen")


def export_rows(links: DataFrame) -> DataFrame:
    """The nine columns of a full export, times in their written form."""
    return links.withColumn("first_seen", iso_time(F.col("first_seen"))).select(*ALL_COLUMNS)


def chosen_links(
    links: DataFrame,
    mode: str = "all",
    link_ids: DataFrame | None = None,
    domain: str = "",
    source: str = "",
    queue: DataFrame | None = None,
) -> DataFrame:
    """The links an export is about; a mode without its argument means all of them."""
    if mode == "selected" and link_ids is not None:
        return links.join(link_ids.select("link_id"), "link_id", "left_semi")
    if mode == "domain" and domain:
        return of_domain(links, domain)
    if mode == "source" and source:
        return links.where(F.col("source_file") == source)
    if mode == "queue" and queue is not None:
        return links.join(queue.select("link_id"), "link_id", "left_semi")
    return links


def export_columns(
    links: DataFrame,
    normalized: bool = True,
    original: bool = False,
    domain: bool = True,
    source: bool = True,
    timestamps: bool = False,
) -> DataFrame:
    """The columns switched on; the URL alone when none is."""
    columns = []
    if normalized:
        columns += [F.col("normalized_url").alias("url"), F.col("normalized_url")]
    if original:
        columns.append(F.col("original_url"))
    if domain:
        columns += [F.col("hostname").alias("domain"), F.col("registered_domain")]
    if source:
        columns.append(F.col("source_file").alias("source"))
    if timestamps:
        columns += [iso_time(F.col("first_seen")).alias("first_seen"), iso_time(F.col("last_seen")).alias("last_seen")]
    return links.select(*(columns or [F.col("normalized_url").alias("url")]))


def write_rows(
    rows: DataFrame, folder: str, fmt: str = "csv", order: tuple[str, ...] = (), compression: str | None = None
) -> None:
    """Write csv (with header), json (one object a line) or txt (the URL alone), in global order.

    Range partitions, each sorted, make the parts one sorted whole when read in name order. Parts are
    plain text, or compressed by a codec of Spark's (gzip), which readers tell by their names.
    """
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    options = {"compression": compression} if compression else {}
    if fmt == "json":
        rows.write.mode("overwrite").options(**options).json(folder)
    elif fmt == "txt":
        names = [c for c in ("url", "normalized_url") if c in rows.columns]
        value = F.coalesce(*[F.col(c) for c in names], F.lit("")) if names else F.lit("")
        rows.select(value.alias("value")).write.mode("overwrite").options(**options).text(folder)
    else:
        rows.write.mode("overwrite").options(**options).option("header", True).option("escape", '"').csv(folder)


def in_export_order(first: DataFrame) -> DataFrame:
    """First sightings in the order of a full export, by host and URL.

    What follows from a URL is left to be worked out where the rows are then, instead of being moved.
    """
    named = with_url_parts(first).select(*first.columns, "hostname")
    return named.repartitionByRange(*EXPORT_ORDER).sortWithinPartitions(*EXPORT_ORDER).select(*first.columns)


def export_all(
    links: DataFrame, folder: str, fmt: str = "csv", ordered: bool = False, compression: str | None = None
) -> None:
    """A full export; ``ordered`` links are in its order already."""
    write_rows(export_rows(links), folder, fmt, () if ordered else EXPORT_ORDER, compression)


def export_domain(links: DataFrame, name: str, folder: str, fmt: str = "txt") -> None:
    rows = of_domain(links, name).select(F.col("normalized_url").alias("url"))
    write_rows(rows, folder, fmt, ("url",))


def by_directory(links: DataFrame) -> DataFrame:
    """Links with the folder of their host, ``directory``; hosts of one folder share it."""
    return links.withColumn("first_seen", iso_time(F.col("first_seen"))).select(
        safe_directory(F.col("hostname")).alias("directory"), *DOMAIN_COLUMNS
    )


def domain_metadata(domains: DataFrame) -> DataFrame:
    return domains.select(
        safe_directory(F.col("hostname")).alias("directory"),
        "hostname",
        "registered_domain",
        iso_time(F.col("first_seen")).alias("first_seen"),
        iso_time(F.col("last_seen")).alias("last_seen"),
        "link_count",
    )


def export_directories(links: DataFrame, domains: DataFrame, folder: str) -> None:
    """A folder per host with its links as text and CSV, and a table of host metadata.

    Rows are ranged by host and URL, and written once for both formats: most hosts lie in one file, a
    host with very many links in several, and no task writes to more folders than its range holds.
    """
    rows = stage(by_directory(links).repartitionByRange("directory", "normalized_url"))
    sorted_rows = rows.sortWithinPartitions("directory", "normalized_url")
    sorted_rows.write.mode("overwrite").partitionBy("directory").option("header", True).option(
        "escape", '"'
    ).csv(f"{folder}/links_csv")
    sorted_rows.select("directory", F.col("normalized_url").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("directory").text(f"{folder}/links_txt")
    domain_metadata(domains).write.mode("overwrite").json(f"{folder}/metadata")


def export_library(
    library: Library, folder: str, at: Column, fmt: str = "txt", mode: str = "all", columns: dict | None = None, **choice
) -> int:
    """Write the chosen links with the chosen columns and log the export; how many rows."""
    links = library.links(last_seen=bool(columns and columns.get("timestamps")))
    chosen = chosen_links(links, mode, queue=library.queue(), **choice)
    # In the order of their ids, and counted while they are written.
    ordered = chosen.repartitionByRange("link_id").sortWithinPartitions("link_id")
    counted = Observation("written")
    ordered = ordered.observe(counted, F.count(F.lit(1)).alias("n"))
    write_rows(export_columns(ordered, **(columns or {})), folder, fmt)
    written = counted.get["n"]
    library.log("EXPORT CREATED", f"{written} {fmt}", at)
    return written
