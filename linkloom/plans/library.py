"""A link library in a folder: append-only tables, one part per import.

Every import writes its parts under ``import_id=N`` and then a commit row. Readers see the
parts of committed imports only, so a failed import leaves nothing visible and its number is
used again, which overwrites what it left. One import runs at a time.
"""

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import filters, trigrams, workqueue
from linkloom.operators.links import described_hosts, folded_hosts, host_counts, link_sources
from linkloom.operators.reports import import_activity, library_totals, recent_activity
from linkloom.operators.search import PAGE_COLUMNS, LinkFilter, fetch_page, page_size, search, source_links, source_summary
from linkloom.session import counted, stage

SCHEMAS = {
    "commits": (
        "stream string, batch_id long, committed_at timestamp_ntz, last_source_id long, last_link_id long,"
        " unique_urls long, unique_domains long, http_urls long, https_urls long, filter_cells long, import_id long"
    ),
    "occurrences": (
        "source_id long, source_file string, source_row long, col_idx int, source_column string,"
        " seen_at timestamp_ntz, match_idx long, raw_url string, normalized_url string, scheme string,"
        " hostname string, port int, path string, query string, fragment string, valid boolean,"
        " reason string, import_id long"
    ),
    "sources": (
        "source_id long, source_file string, file_path string, file_size long, file_hash string,"
        " imported_at timestamp_ntz, status string, urls_discovered long, urls_inserted long,"
        " duplicates long, invalid_urls long, import_id long"
    ),
    "links": (
        "link_id long, normalized_url string, original_url string, scheme string, hostname string,"
        " registered_domain string, port int, path string, query string, fragment string,"
        " first_seen timestamp_ntz, last_seen timestamp_ntz, source_id long, source_file string,"
        " source_row long, source_column string, import_id long"
    ),
    "resightings": "normalized_url string, last_seen timestamp_ntz, import_id long",
    "url_filters": "cells long, cell long, bits long, import_id long",
    "hosts": "hostname string, import_id long",
    "host_counts": (
        "hostname string, first_seen timestamp_ntz, last_seen timestamp_ntz, link_count long, import_id long"
    ),
    "sketches": "registered_domains binary, import_id long",
    "trigrams": "file string, codes array<int>, import_id long",
    "queue_events": (
        "seq long, action string, link_id long, priority string, event_time timestamp_ntz, change_id long"
    ),
    "activity": "seq long, event string, detail string, created_at timestamp_ntz, change_id long",
}

# What every commit row says of the library after it.
STATE = ("last_source_id", "last_link_id", "unique_urls", "unique_domains", "http_urls", "https_urls")
# URLs or probes that are broadcast at most; more meet by a shuffle.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The table, broadcast if it is small."""
    count = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def utc(moment: datetime.datetime | str) -> Column:
    """A point in time, to the second, as it is stored."""
    text = moment if isinstance(moment, str) else moment.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(text.rstrip("Z").replace("T", " ")).cast("timestamp_ntz")


class Library:
    """Tables of one library; all of them DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str) -> DataFrame:
        schema = SCHEMAS[table]
        try:
            return self.spark.read.schema(schema).parquet(self.path(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def write_part(self, df: DataFrame, table: str, import_id: int, **numbers: Column) -> dict[str, int]:
        """Write one import's rows; a part left by a failed attempt is replaced.

        Returns rows, how many there are, and the aggregates ``numbers``, taken while they are written.
        """
        columns = [f.name for f in self.spark.createDataFrame([], SCHEMAS[table]).schema]
        key = columns.pop()
        told, watched = counted(df.select(*columns), **numbers)
        watched.write.mode("overwrite").parquet(f"{self.path(table)}/{key}={import_id}")
        return told.get

    # Reading -------------------------------------------------------------------------------

    def commits(self) -> DataFrame:
        return self._read("commits")

    def last_import(self) -> int:
        """Number of the last committed import, 0 before the first."""
        return self.commits().agg(F.coalesce(F.max("import_id"), F.lit(0))).first()[0]

    def batch_done(self, stream: str, batch_id: int) -> bool:
        done = (F.col("stream") == stream) & (F.col("batch_id") == batch_id)
        return not self.commits().where(done).isEmpty()

    def table(self, name: str, until: int | None = None) -> DataFrame:
        """A table as of an import; import ids are partitions, so others are not even listed."""
        last = self.last_import() if until is None else until
        return self._read(name).where(F.col("import_id") <= last)

    def search(self, conditions: LinkFilter) -> DataFrame:
        """The links that meet the conditions, with their queue status, reading few files where ``q`` or
        ``path_contains`` has three letters in a row.

        Only files that hold all trigrams of these are opened, and those of imports that left none.
        """
        wanted = trigrams.pattern_codes(conditions.q) | trigrams.pattern_codes(conditions.path_contains)
        links = self.table("links")
        if wanted:
            last = self.last_import()
            unindexed = [r.import_id for r in self._filters(last) if r.filter_cells is None]
            files = self.table("trigrams", last).where(trigrams.holds(wanted)).select("import_id", "file").distinct().collect()
            places = [f"{self.path('links')}/import_id={r.import_id}/{r.file}" for r in files]
            places += [f"{self.path('links')}/import_id={i}" for i in unindexed]
            links = self._read_places("links", places)
        return search(workqueue.with_status(links, self.queue()), conditions)

    def _read_places(self, name: str, places: list[str]) -> DataFrame:
        """A table from some of its folders or files; others are not even listed."""
        if not places:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", self.path(name)).parquet(*places)

    def of_imports(self, name: str, import_ids: list[int]) -> DataFrame:
        """A table's rows of some imports."""
        return self._read_places(name, [f"{self.path(name)}/import_id={i}" for i in import_ids])

    def occurrences(self) -> DataFrame:
        return self.table("occurrences")

    def sources(self) -> DataFrame:
        return self.table("sources")

    def links(self, last_seen: bool = False) -> DataFrame:
        """Links with their queue status.

        ``last_seen`` brings in sightings by later imports, which costs a join; without it the
        column tells the last sighting in the import that found the link.
        """
        found = self.table("links")
        if last_seen:
            again = (
                self.table("resightings")
                .groupBy("normalized_url")
                .agg(F.max("last_seen").alias("seen_again"))
            )
            found = (
                found.join(again, "normalized_url", "left")
                .withColumn("last_seen", F.greatest("last_seen", "seen_again"))
                .drop("seen_again")
            )
        return workqueue.with_status(found, self.queue())

    def domains(self) -> DataFrame:
        """Hosts with their first and last sighting and number of links, folded from the sums of each import."""
        last = self.last_import()
        counts = self.table("host_counts", last).drop("import_id")
        older = [r.import_id for r in self._filters(last) if r.filter_cells is None]
        if older:
            links, again = self.of_imports("links", older), self.of_imports("resightings", older)
            counts = counts.unionByName(host_counts(links, again))
        return described_hosts(folded_hosts(counts))

    def totals(self) -> dict[str, int]:
        """Links, hosts, registered domains, sources and queue entries, without a look at the links."""
        return library_totals(self.domains(), self.sources(), self.queue()).first().asDict()

    def registered_domain_estimate(self) -> int:
        """About how many registered domains there are, from a sketch of fixed size that each import left."""
        union = self.table("sketches").agg(F.hll_sketch_estimate(F.hll_union_agg("registered_domains")).alias("n"))
        return union.first().n or 0

    def queue_events(self) -> DataFrame:
        return self._read("queue_events")

    def queue(self) -> DataFrame:
        return workqueue.current_queue(self.queue_events())

    def activity(self, limit: int = 40) -> DataFrame:
        """The newest events: imports, as the sources tell, queue additions and exports."""
        logged = self._read("activity").drop("change_id")
        imports = import_activity(self.sources(), limit)
        return recent_activity(logged.unionByName(imports), limit)

    def _filters(self, until: int) -> list:
        """import_id and filter_cells of all imports up to one; null where an older version left no filter."""
        return self.commits().where(F.col("import_id") <= until).select("import_id", "filter_cells").collect()

    def page(
        self,
        conditions: LinkFilter = LinkFilter(),
        limit: int = 50,
        after: int | None = None,
        offset: int = 0,
        include_total: bool = False,
    ) -> dict:
        """``fetch_page`` of the library's links, reading the newest imports first and no more than it takes.

        Link ids rise from import to import and each commit row has the last one, so imports whose ids all
        lie behind ``after`` are passed over, and older ones are opened, more each time, until the page is full.
        """
        if after is None and offset > 0:
            return fetch_page(self.links(), conditions, limit, after, offset, include_total)
        size = page_size(limit)
        commits = self.commits().select("import_id", "last_link_id").orderBy("import_id").collect()
        firsts = [0, *[r.last_link_id for r in commits]]
        parts = [
            r.import_id for r, before in zip(commits, firsts) if r.last_link_id > before and (after is None or before + 1 < after)
        ][::-1]
        rows: list = []
        step = 1
        while parts and len(rows) <= size:
            opened, parts, step = parts[:step], parts[step:], 2 * step
            links = workqueue.with_status(self.of_imports("links", opened), self.queue())
            found = search(links, conditions).select(*PAGE_COLUMNS)
            if after is not None:
                found = found.where(F.col("link_id") < after)
            rows += found.orderBy(F.desc("link_id")).limit(size + 1 - len(rows)).collect()
        more = len(rows) > size
        return {
            "items": [r.asDict() for r in rows[:size]],
            "has_more": more,
            "next": rows[size - 1].link_id if more else None,
            "total": search(self.links(), conditions).count() if include_total and after is None else None,
            "after": after,
            "limit": size,
            "offset": 0,
        }

    def source_page(self, source_id: int, limit: int = 50, offset: int = 0) -> dict | None:
        """A source with its numbers of hosts and places and a page of its links; None if there is none.

        Of the occurrences only those of its import are read.
        """
        source = self.sources().where(F.col("source_id") == source_id).first()
        if source is None:
            return None
        seen = self.of_imports("occurrences", [source.import_id]).where(F.col("source_id") == source_id)
        summary = source_summary(seen).first()
        links = source_links(link_sources(seen), self.links(), source_id, limit, offset).collect()
        return {
            "source": source.asDict(),
            "domain_count": summary.domain_count if summary else 0,
            "url_total": summary.url_total if summary else 0,
            "limit": page_size(limit),
            "offset": max(int(offset), 0),
            "urls": [r.asDict() for r in links],
        }

    def known_links(self, urls: DataFrame, until: int, rows: int) -> DataFrame:
        """Those of ``rows`` different URLs (normalized_url) that the library holds as of an import.

        Every import leaves a filter of its links. Links are read, and compared in full, of imports only
        whose filter lets one of the URLs pass, and of those without a filter.
        """
        imports = self._filters(until)
        unfiltered = [r.import_id for r in imports if r.filter_cells is None]
        sizes = sorted({r.filter_cells for r in imports if r.filter_cells})
        wanted = urls.select("normalized_url")
        opened = list(unfiltered)
        if sizes:
            asked = sized(filters.probes(wanted, "normalized_url", sizes), rows * len(sizes) * filters.WORDS)
            may = stage(filters.passed(self.table("url_filters", until), asked, "normalized_url", ["import_id"]))
            opened += [r.import_id for r in may.select("import_id").distinct().collect()]
            if not unfiltered:
                wanted = may.select("normalized_url").distinct()
        links = self.of_imports("links", opened).select("normalized_url")
        return links.join(sized(wanted), "normalized_url", "left_semi")

    def new_hosts(self, hosts: DataFrame, until: int) -> DataFrame:
        """Those of the hosts (hostname) that no import before left; a host is kept by its first import."""
        listed = self.table("hosts", until).select("hostname")
        unfiltered = [r.import_id for r in self._filters(until) if r.filter_cells is None]
        if unfiltered:
            listed = listed.unionByName(self.of_imports("links", unfiltered).select("hostname"))
        known = listed.join(sized(hosts), "hostname", "left_semi").distinct()
        return hosts.join(sized(known), "hostname", "left_anti")

    # Changing ------------------------------------------------------------------------------

    def state(self, import_id: int) -> dict[str, int]:
        """Last numbers given and totals of the library after an import, from its commit row."""
        row = self.commits().where(F.col("import_id") == import_id).select(*STATE).first()
        return row.asDict() if row else dict.fromkeys(STATE, 0)

    def commit(
        self,
        import_id: int,
        at: Column,
        stream: str | None,
        batch_id: int | None,
        state: dict[str, int],
        filter_cells: int | None = None,
    ) -> None:
        """Make an import visible, with the library's ``state`` after it and the size of its filter."""
        row = self.spark.range(1).select(
            F.lit(stream).cast("string").alias("stream"),
            F.lit(batch_id).cast("long").alias("batch_id"),
            at.alias("committed_at"),
            *[F.lit(state[name]).cast("long").alias(name) for name in STATE],
            F.lit(filter_cells).cast("long").alias("filter_cells"),
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path('commits')}/import_id={import_id}")

    def _append(self, df: DataFrame, table: str) -> int:
        """Append a change, whose number follows the last one; how many rows it has."""
        last = self._read(table).agg(F.coalesce(F.max("change_id"), F.lit(0))).first()[0]
        return self.write_part(df, table, last + 1)["rows"]

    def log(self, event: str, detail: str, at: Column) -> None:
        last = self._read("activity").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
        self._append(
            last.select(
                (F.col("last") + 1).alias("seq"),
                F.lit(event).alias("event"),
                F.lit(detail).alias("detail"),
                at.alias("created_at"),
            ),
            "activity",
        )

    def _next_seq(self) -> int:
        return self.queue_events().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1

    def queue_add(self, link_ids: DataFrame, priority: str, at: Column) -> int:
        """Queue links that are not queued yet; how many. An id without a link is an error."""
        links = self.table("links")
        unknown = link_ids.join(links.select("link_id"), "link_id", "left_anti")
        if not unknown.isEmpty():
            raise ValueError("queue_add: some link ids are not in the library")
        seq = F.lit(self._next_seq()) + F.monotonically_increasing_id()
        events = workqueue.add_events(self.queue(), links, link_ids, F.lit(priority), at, seq)
        added = self._append(events, "queue_events")
        if added:
            self.log("HARVEST QUEUED", f"{added} urls", at)
        return added

    def queue_remove(self, queue_ids: DataFrame, at: Column) -> int:
        seq = F.lit(self._next_seq()) + F.monotonically_increasing_id()
        return self._append(workqueue.remove_events(self.queue(), queue_ids, at, seq), "queue_events")

    def queue_clear(self, at: Column) -> None:
        self._append(workqueue.clear_event(self.queue_events(), at), "queue_events")
