"""The hand-off queue, kept as an append-only log of events.

Events have seq (their order), action (ADD, REMOVE or CLEAR), link_id (NULL for CLEAR), priority
and at. Adding a queued link changes nothing, so an entry is the first ADD after the link's last
removal.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import known_priority, priority_rank


# Events of one link come together a million sequence numbers at a time.
_SPAN_BITS = 20


def current_queue(events: DataFrame) -> DataFrame:
    """The queue after all events: queue_id, link_id, status, priority and added_at.

    A link's entry is worked out within spans of the log first: its last removal there and the first
    ADD after that. A span has at most a million events, whatever share of them one link holds, and
    leaves one row per link for the second step.
    """
    cleared = events.where(F.col("action") == "CLEAR").agg(
        F.coalesce(F.max("seq"), F.lit(-1)).alias("cleared_at"), F.lit(1).alias("one")
    )
    # One row; it holds the last clearing.
    alive = (
        events.where(F.col("action").isin("ADD", "REMOVE"))
        .withColumn("one", F.lit(1))
        .join(F.broadcast(cleared), "one")
        .where(F.col("seq") > F.col("cleared_at"))
        .withColumn("span", F.shiftright("seq", _SPAN_BITS))
    )
    removals = (
        alive.where(F.col("action") == "REMOVE")
        .groupBy("link_id", "span")
        .agg(F.max("seq").alias("removed_at"))
    )
    entries = (
        alive.where(F.col("action") == "ADD")
        .join(removals, ["link_id", "span"], "left")
        .where(F.col("seq") > F.coalesce("removed_at", F.lit(-1)))
        .groupBy("link_id", "span")
        .agg(F.min(F.struct("seq", "priority", "event_time")).alias("entry"))
    )
    removed = removals.groupBy("link_id").agg(F.max("removed_at").alias("removed_at"))
    return (
        entries.join(removed, "link_id", "left")
        .where(F.col("entry.seq") > F.coalesce("removed_at", F.lit(-1)))
        .groupBy("link_id")
        .agg(F.min("entry").alias("entry"))
        .select(
            F.col("entry.seq").alias("queue_id"),
            "link_id",
            F.lit("QUEUED").alias("status"),
            known_priority(F.col("entry.priority")).alias("priority"),
            F.col("entry.event_time").alias("added_at"),
        )
    )


def queue_list(queue: DataFrame, links: DataFrame, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """The queue with its links: high priority first, then the newest entries."""
    listed = queue.join(
        links.select("link_id", "normalized_url", "hostname", "path"), "link_id"
    ).orderBy(priority_rank(F.col("priority")), F.desc("queue_id"))
    if offset:
        listed = listed.offset(offset)
    return listed if limit is None else listed.limit(limit)


def add_events(
    queue: DataFrame, links: DataFrame, wanted: DataFrame, priority: Column, at: Column, seq: Column
) -> DataFrame:
    """ADD events for the wanted links that exist and are not queued yet.

    The wanted links are few beside all links, which are not shuffled where the wanted can be broadcast.
    """
    return (
        links.select("link_id")
        .join(wanted.select("link_id"), "link_id", "left_semi")
        .distinct()
        .join(queue.select("link_id"), "link_id", "left_anti")
        .select(
            seq.cast("long").alias("seq"),
            F.lit("ADD").alias("action"),
            "link_id",
            known_priority(priority).alias("priority"),
            at.alias("event_time"),
        )
    )


def remove_events(queue: DataFrame, queue_ids: DataFrame, at: Column, seq: Column) -> DataFrame:
    """REMOVE events for queue entries that exist."""
    return queue.join(queue_ids.select("queue_id"), "queue_id", "left_semi").select(
        seq.cast("long").alias("seq"),
        F.lit("REMOVE").alias("action"),
        "link_id",
        F.lit(None).cast("string").alias("priority"),
        at.alias("event_time"),
    )


def clear_event(events: DataFrame, at: Column) -> DataFrame:
    """One CLEAR event after all events so far."""
    return events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last")).select(
        (F.col("last") + 1).alias("seq"),
        F.lit("CLEAR").alias("action"),
        F.lit(None).cast("long").alias("link_id"),
        F.lit(None).cast("string").alias("priority"),
        at.alias("event_time"),
    )


def with_status(links: DataFrame, queue: DataFrame) -> DataFrame:
    """Links with their status: QUEUED while they are in the queue, else DISCOVERED."""
    queued = queue.select("link_id", F.lit("QUEUED").alias("queued"))
    return (
        links.drop("status")
        .join(queued, "link_id", "left")
        .withColumn("status", F.coalesce("queued", F.lit("DISCOVERED")))
        .drop("queued")
    )


def queued_links(links: DataFrame, queue: DataFrame) -> DataFrame:
    return links.join(queue.select("link_id"), "link_id", "left_semi")
