"""Links, domains and provenance derived from occurrences."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.barrier import computed_once
from linkloom.functions.urls import split_url
from linkloom.operators.hosts import with_registered_domain
from linkloom.operators.numbering import with_dense_ids
from linkloom.operators.occurrences import READING_ORDER


# What a first sighting can tell, besides its URL.
SIGHTING_COLUMNS = (*READING_ORDER, "source_file", "source_column", "first_seen", "last_seen", "sightings", "original_url")
# What aggregates of fixed width tell, with no struct to compare.
_PLAIN = {"source_id", "last_seen", "sightings"}


def first_sightings(occurrences: DataFrame, wanted: Sequence[str] = SIGHTING_COLUMNS) -> DataFrame:
    """One row per valid normalized_url: its first occurrence, last sighting and frequency.

    A minimum over a struct that starts with the reading order needs a single shuffle and is
    combined on the map side, so a URL that holds a third of all rows is sent once per task. The
    URL parts follow from normalized_url and are not shuffled; the original text only where it
    differs, and of all columns just those ``wanted``. Where these are of fixed width, the reading
    order's first column included, it is a hash aggregate: nothing is sorted.
    """
    plain = {
        "source_id": F.when(~F.bool_or(F.col("source_id").isNull()), F.min("source_id")),
        "last_seen": F.max("seen_at"),
        "sightings": F.count(F.lit(1)),
    }
    grouped = occurrences.where("valid").groupBy("normalized_url")
    names = [c for c in SIGHTING_COLUMNS if c in wanted]
    if set(names) <= _PLAIN:
        if not names:
            return occurrences.where("valid").select("normalized_url").distinct()
        return grouped.agg(*[plain[c].alias(c) for c in names])
    carried = {
        "original_url": F.expr("nullif(raw_url, normalized_url)").alias("original_url"),
        "source_file": F.col("source_file"),
        "source_column": F.col("source_column"),
        "first_seen": F.col("seen_at").alias("first_seen"),
    }
    first = F.struct(*READING_ORDER, *[c for name, c in carried.items() if name in names])
    found = grouped.agg(
        F.min(first).alias("first"), *[plain[c].alias(c) for c in ("last_seen", "sightings") if c in names]
    )
    told = {c: F.col(c) if c in ("last_seen", "sightings") else F.col(f"first.{c}") for c in names}
    if "original_url" in told:
        told["original_url"] = F.coalesce("first.original_url", "normalized_url")
    return found.select("normalized_url", *[c.alias(name) for name, c in told.items()])


def sighting_times(occurrences: DataFrame) -> DataFrame:
    """normalized_url, first_seen and last_seen of every link, for reports that need no more.

    Where times rise with the reading order, as in an import, they are those of the first and the
    last occurrence. Both are of fixed width, so this is a hash aggregate.
    """
    return (
        occurrences.where("valid")
        .groupBy("normalized_url")
        .agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    )


def with_url_parts(df: DataFrame) -> DataFrame:
    """Add scheme, hostname, port, path, query and fragment of normalized_url."""
    parts = [
        F.col("scheme"),
        F.col("host").alias("hostname"),
        F.when(F.col("port_text") != "", F.col("port_text").cast("int")).alias("port"),
        F.col("path"),
        F.col("query"),
        F.col("fragment"),
    ]
    return computed_once(split_url(df, "normalized_url"), df.columns, parts)


def described(first: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """First sightings with their URL parts and registered domain."""
    return with_registered_domain(with_url_parts(first), rules=rules)


def links(
    occurrences: DataFrame, rules: DataFrame | None = None, wanted: Sequence[str] = SIGHTING_COLUMNS
) -> DataFrame:
    """The link table without ids."""
    return described(first_sightings(occurrences, wanted), rules)


def with_link_ids(
    first: DataFrame, start: Column | int = 1, wanted: Sequence[str] = SIGHTING_COLUMNS
) -> DataFrame:
    """Number first sightings in their order, so that the highest id is the newest link.

    Numbering writes the rows once, so it comes before the columns that can be derived, and without
    those columns of the order that are not ``wanted``.
    """
    left_out = [c for c in READING_ORDER if c not in wanted]
    return with_dense_ids(first, list(READING_ORDER), "link_id", start, left_out)


def domains(links: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per hostname with first and last sighting and number of links.

    Hosts are classified after they are grouped, so the rules meet each host once.
    """
    grouped = links.groupBy("hostname").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.count(F.lit(1)).alias("link_count"),
    )
    return described_hosts(grouped, rules)


def described_hosts(grouped: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Hosts with their registered domain."""
    return with_registered_domain(grouped, rules=rules).select(
        "hostname", "registered_domain", "first_seen", "last_seen", "link_count"
    )


def host_counts(links: DataFrame, resightings: DataFrame) -> DataFrame:
    """What new links and later sightings (normalized_url, last_seen) of known ones add to their hosts."""
    new = links.groupBy("hostname").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("link_count")
    )
    again = with_url_parts(resightings.select("normalized_url", "last_seen")).groupBy("hostname").agg(
        F.max("last_seen").alias("last_seen")
    )
    again = again.select("hostname", F.lit(None).cast("timestamp_ntz").alias("first_seen"), "last_seen", F.lit(0).cast("long").alias("link_count"))
    return folded_hosts(new.unionByName(again))


def folded_hosts(counts: DataFrame) -> DataFrame:
    """Sums of hosts; they can be folded in any order and any number of times."""
    return counts.groupBy("hostname").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("link_count").alias("link_count")
    )


def domain_counts(occurrences: DataFrame) -> DataFrame:
    """Hostname and number of links, from occurrences, with as little shuffled as possible."""
    unique = occurrences.where("valid").select("normalized_url", "hostname").distinct()
    return unique.groupBy("hostname").agg(F.count(F.lit(1)).alias("link_count"))


def domain_sources(occurrences: DataFrame) -> DataFrame:
    """Number of different sources that mention a hostname."""
    return (
        occurrences.where("valid")
        .groupBy("hostname")
        .agg(F.countDistinct("source_id").alias("source_count"))
    )


def link_sources(occurrences: DataFrame) -> DataFrame:
    """Every place a link was seen.

    Repeats inside one CSV cell count once; a text line has no column and keeps its repeats.
    """
    valid = occurrences.where("valid").select(
        "normalized_url", "source_id", "source_row", "source_column"
    )
    cells = valid.where(F.col("source_column").isNotNull()).distinct()
    return valid.where(F.col("source_column").isNull()).unionByName(cells)


def source_counters(occurrences: DataFrame, first: DataFrame) -> DataFrame:
    """Discovered, inserted, duplicate and invalid URLs per source.

    ``first`` holds the first sightings; a source inserted those it saw first, every other valid
    occurrence is a duplicate. Both sides are counts per source before they meet.
    """
    seen = occurrences.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("urls_discovered"),
        F.count_if(~F.col("valid")).alias("invalid_urls"),
    )
    inserted = first.groupBy("source_id").agg(F.count(F.lit(1)).alias("urls_inserted"))
    return (
        seen.join(inserted, "source_id", "left")
        .withColumn("urls_inserted", F.coalesce("urls_inserted", F.lit(0)))
        .withColumn(
            "duplicates", F.expr("urls_discovered - invalid_urls - urls_inserted")
        )
        .select("source_id", "urls_discovered", "urls_inserted", "duplicates", "invalid_urls")
    )


def new_links(found: DataFrame, known: DataFrame) -> DataFrame:
    """Links whose normalized_url the library does not hold yet."""
    return found.join(known.select("normalized_url"), "normalized_url", "left_anti")
