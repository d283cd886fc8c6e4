"""Statistics of the library."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.hosts import tld_bucket
from linkloom.operators.search import list_rows


def scheme_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("scheme").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "scheme")


def top_domains(domain_counts: DataFrame, limit: int = 20) -> DataFrame:
    """The hosts with most links; works on any table with hostname and link_count."""
    return (
        domain_counts.select("hostname", "link_count")
        .orderBy(F.desc("link_count"), "hostname")
        .limit(limit)
    )


def registered_domain_count(domains: DataFrame, approximate: bool = False) -> DataFrame:
    """How many registered domains there are; ``approximate`` from a sketch of fixed size."""
    named = domains.where(F.col("registered_domain") != "")
    count = F.approx_count_distinct if approximate else F.count_distinct
    return named.agg(count("registered_domain").alias("registered_domains"))


def library_totals(domains: DataFrame, sources: DataFrame, queue: DataFrame) -> DataFrame:
    """Links, hosts, registered domains, sources and queue entries in one row.

    Links are summed from the domain table, which is far smaller. All sides of the final joins
    are single rows.
    """
    by_registered = domains.groupBy("registered_domain").agg(
        F.sum("link_count").alias("links"), F.count(F.lit(1)).alias("hosts")
    )
    of_links = by_registered.agg(
        F.coalesce(F.sum("links"), F.lit(0)).alias("total_urls"),
        F.coalesce(F.sum("hosts"), F.lit(0)).alias("total_domains"),
        F.count_if(F.col("registered_domain") != "").alias("registered_domains"),
        F.lit(1).alias("one"),
    )
    of_sources = sources.agg(F.count(F.lit(1)).alias("source_files"), F.lit(1).alias("one"))
    of_queue = queue.agg(F.count(F.lit(1)).alias("queued"), F.lit(1).alias("one"))
    return of_links.join(of_sources, "one").join(of_queue, "one").drop("one")


def tld_breakdown(domain_counts: DataFrame) -> DataFrame:
    return (
        domain_counts.groupBy(tld_bucket(F.col("hostname")).alias("bucket"))
        .agg(F.sum("link_count").alias("n"))
        .orderBy(F.desc("n"), "bucket")
    )


def library_growth(links: DataFrame, months: int = 24, newest: bool = False) -> DataFrame:
    """New links per month: the oldest months, or with ``newest`` the latest."""
    month = F.date_format("first_seen", "yyyy-MM").alias("month")
    order = F.desc("month") if newest else F.asc("month")
    return (
        links.where(F.col("first_seen").isNotNull())
        .groupBy(month)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(order)
        .limit(months)
    )


def source_activity(sources: DataFrame, days: int = 14) -> DataFrame:
    """Imported sources and URLs found per day, latest days first."""
    return (
        sources.groupBy(F.date_format("imported_at", "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("sources"), F.sum("urls_discovered").alias("urls"))
        .orderBy(F.desc("day"))
        .limit(days)
    )


def newest_sources(sources: DataFrame) -> DataFrame:
    """All sources, newest import first."""
    return sources.orderBy(F.desc("imported_at"), F.desc("source_id"))


def sources_list(sources: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the sources, newest import first."""
    return list_rows(newest_sources(sources), limit, offset)


def last_import(sources: DataFrame) -> DataFrame:
    return sources_list(sources, 1).select("source_file", "imported_at")


def import_report(sources: DataFrame, links: DataFrame) -> DataFrame:
    """One row: what an import found, and the size of the whole library after it."""
    run = sources.agg(
        F.count_if(F.col("status") == "complete").alias("files_processed"),
        F.count_if(F.col("status") == "skipped").alias("files_skipped"),
        F.coalesce(F.sum("urls_discovered"), F.lit(0)).alias("urls_discovered"),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("invalid_urls"), F.lit(0)).alias("invalid_urls"),
        F.lit(1).alias("one"),
    )
    hosts = links.groupBy("hostname").agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(F.col("scheme") == "http").alias("http"),
        F.count_if(F.col("scheme") == "https").alias("https"),
    )
    whole = hosts.agg(
        F.coalesce(F.sum("links"), F.lit(0)).alias("unique_urls"),
        F.count(F.lit(1)).alias("unique_domains"),
        F.coalesce(F.sum("http"), F.lit(0)).alias("http_urls"),
        F.coalesce(F.sum("https"), F.lit(0)).alias("https_urls"),
        F.lit(1).alias("one"),
    )
    return run.join(whole, "one").drop("one")


def import_activity(sources: DataFrame, limit: int = 40) -> DataFrame:
    """The newest import events with the library's size after each, newest first.

    A URL list has no file and so no size. The size after a source is the size of the library less what later sources added. The window
    runs over the ``limit`` newest sources only.
    """
    newest = sources.orderBy(F.desc("source_id")).limit(limit)
    total = sources.agg(F.sum("urls_inserted").alias("total"), F.lit(1).alias("one"))
    later = Window.orderBy(F.desc("source_id")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        newest.withColumn("later", F.coalesce(F.sum("urls_inserted").over(later), F.lit(0)))
        .withColumn("one", F.lit(1))
        .join(total, "one")
        .select(
            F.when(F.col("file_size") == 0, "HARVEST INDEXED").otherwise("SOURCE IMPORTED").alias("event"),
            F.concat("source_file", F.lit(" +"), (F.col("total") - F.col("later")).cast("string")).alias("detail"),
            F.col("imported_at").alias("created_at"),
            F.col("source_id").alias("seq"),
        )
    )


def recent_activity(events: DataFrame, limit: int = 40) -> DataFrame:
    """The newest events first; ``seq`` breaks ties of one second."""
    return (
        events.orderBy(F.desc("created_at"), F.desc("seq"))
        .limit(limit)
        .select("event", "detail", "created_at")
    )
