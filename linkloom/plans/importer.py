"""Importing files and URL lists into a library."""

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed
from linkloom.functions.urls import normalize_urls
from linkloom.operators import filters
from linkloom.operators.links import described, first_sightings, host_counts, with_link_ids
from linkloom.operators.numbering import with_dense_ids
from linkloom.operators.reports import import_report
from linkloom.operators.trigrams import file_trigrams
from linkloom.plans.library import Library, sized
from linkloom.session import stage_counted
from linkloom.sources.csv import scan_csv
from linkloom.sources.files import (
    discover_files,
    empty_fingerprint,
    fingerprints,
    hidden_files,
    literal_paths,
    path_order,
    wanted_file,
)
from linkloom.sources.pages import distinct_links, page_links
from linkloom.sources.tables import listed_urls, new_files, short_name
from linkloom.sources.text import scan_text

Progress = Callable[[str, dict[str, int]], None]


@dataclass(frozen=True)
class ImportResult:
    import_id: int
    report: dict


class Importer:
    """Runs imports. Time is an argument everywhere, so that a repeated run gives the same rows."""

    def __init__(
        self, library: Library, schemes: Sequence[str] = fixed.DEFAULT_SCHEMES, progress: Progress | None = None
    ):
        """``progress`` is called with a step's name and its numbers as soon as the step is written: FILES
        (files, files_skipped), SCANNED (discovered, invalid), INDEXED (discovered, inserted, duplicate,
        invalid). The numbers are taken while rows are written, so nothing is read for them."""
        self.library = library
        self.spark = library.spark
        self.schemes = schemes
        self._tell = progress or (lambda step, numbers: None)

    def import_path(
        self,
        target: str,
        at: Column,
        recursive: bool = False,
        stream: str | None = None,
        batch_id: int | None = None,
    ) -> ImportResult:
        """Import the text and CSV files of a folder, or one file; known contents are skipped.

        Files with hidden names cannot be read and count as skipped.
        """
        hidden = hidden_files(self.spark, target, recursive).count()
        files = discover_files(self.spark, target, recursive)
        wanted = lambda path: wanted_file(path, target, recursive)
        return self.import_files(files, target, at, stream, batch_id, wanted, hidden)

    def import_files(
        self,
        files: DataFrame,
        target: str | list[str],
        at: Column,
        stream: str | None = None,
        batch_id: int | None = None,
        wanted: Callable[[Column], Column] | None = None,
        hidden: int = 0,
    ) -> ImportResult:
        """Import discovered files, all of which lie below ``target``; ``wanted`` tests their paths."""
        library = self.library
        last = library.last_import()
        import_id = last + 1
        # Content is read twice: once for the hash, once more only for what is new.
        empty = F.when(F.col("file_size") == 0, empty_fingerprint())
        listed, all_files = stage_counted(
            files.select("path", "file_name", "file_size")
            .join(self._hashes(files, target, wanted), "path", "left")
            .withColumn("file_hash", F.coalesce("file_hash", empty))
            .withColumn("sort_key", path_order()[0])
        )
        known = library.table("sources", last)
        fresh = new_files(listed, known, ["sort_key"])
        taken, new = stage_counted(
            with_dense_ids(fresh, ["sort_key"], "source_id", library.state(last)["last_source_id"] + 1)
        )
        skipped = all_files["rows"] - new["rows"] + hidden
        self._tell("FILES", {"files": new["rows"], "files_skipped": skipped})
        found = normalize_urls(self._scan(taken, at), schemes=self.schemes, trimmed=True)
        origin = taken.select(
            "source_id",
            F.col("file_name").alias("source_file"),
            F.col("path").alias("file_path"),
            "file_size",
            "file_hash",
        )
        return self._finish(import_id, found, origin, at, skipped, stream, batch_id)

    def import_list(
        self, urls: DataFrame, url: str, source_name: str, at: Column, label: str = "harvest"
    ) -> ImportResult:
        """Import an already discovered URL list with a ``position`` column as a source of its own."""
        library = self.library
        last = library.last_import()
        source_id = library.state(last)["last_source_id"] + 1
        found = listed_urls(urls, url, source_name, label, source_id, seen_at=at)
        origin = self.spark.range(1).select(
            F.lit(source_id).cast("long").alias("source_id"),
            short_name(F.lit(source_name)).alias("source_file"),
            F.lit(label).alias("file_path"),
            F.lit(0).cast("long").alias("file_size"),
            # The import number keeps two lists of one name and second apart.
            F.sha2(
                F.concat_ws(":", F.lit(label), F.lit(source_name), at.cast("string"), F.lit(last + 1)), 256
            ).alias("file_hash"),
        )
        return self._finish(last + 1, found, origin, at, 0, None, None)

    def import_pages(
        self, pages: DataFrame, key: str, source_name: str, at: Column, label: str = "harvest"
    ) -> ImportResult:
        """Import the outward links of stored result pages (key, html and engine) as one list."""
        found = distinct_links(page_links(pages, key), key)
        return self.import_list(found, "url", source_name, at, label)

    def _hashes(self, files: DataFrame, target: str | list[str], wanted: Callable[[Column], Column] | None) -> DataFrame:
        """path and file_hash of the files that have bytes."""
        if files.where("file_size > 0").isEmpty():
            return self.spark.createDataFrame([], "path string, file_hash string")
        return fingerprints(self.spark, target, wanted).select("path", "file_hash")

    def _scan(self, taken: DataFrame, at: Column) -> DataFrame:
        """URLs of the taken files in reading order.

        The reader gets the list of new files, so nothing else is read. Spark's own listing keeps
        every path in the driver as well.
        """
        paths = [r.path for r in taken.where("file_size > 0").select("path").collect()]
        csv_paths = literal_paths([p for p in paths if p.lower().endswith(".csv")])
        text_paths = literal_paths([p for p in paths if not p.lower().endswith(".csv")])
        columns = "path string, source_row long, col_idx int, source_column string, match_idx long, raw_url string"
        found = self.spark.createDataFrame([], columns)
        if text_paths:
            lines = scan_text(self.spark, text_paths, only_other_than_csv=True)
            found = found.unionByName(
                lines.withColumn("col_idx", F.lit(0)).withColumn("source_column", F.lit(None).cast("string"))
            )
        if csv_paths:
            found = found.unionByName(scan_csv(self.spark, csv_paths, only_csv=True))
        files = taken.select("path", "source_id", F.col("file_name").alias("source_file"))
        return found.join(sized(files), "path").select(
            "source_id",
            "source_file",
            "source_row",
            "col_idx",
            "source_column",
            at.alias("seen_at"),
            "match_idx",
            "raw_url",
        )

    def _finish(
        self,
        import_id: int,
        found: DataFrame,
        origin: DataFrame,
        at: Column,
        skipped: int,
        stream: str | None,
        batch_id: int | None,
    ) -> ImportResult:
        """Write occurrences, new links, resightings and sources, then commit."""
        library = self.library
        last = import_id - 1
        scanned = library.write_part(found, "occurrences", import_id, invalid=F.count_if(~F.col("valid")))
        numbers = {"discovered": scanned["rows"], "invalid": scanned["invalid"]}
        self._tell("SCANNED", numbers)
        written = library.table("occurrences", import_id).where(F.col("import_id") == import_id)

        # The library is asked for this import's URLs by its filters; of few of its links more is read.
        before = library.state(last)
        first, n_first = stage_counted(first_sightings(written))
        seen_before, n_known = stage_counted(library.known_links(first, last, n_first["rows"]))
        again = sized(seen_before, n_known["rows"])
        fresh = first.join(again, "normalized_url", "left_anti")
        numbered = described(with_link_ids(fresh, before["last_link_id"] + 1))
        # Clustered by host, so that a search for one host reads few row groups; a host with very
        # many links is spread by its URLs.
        indexed = library.write_part(
            numbered.repartitionByRange("hostname", "normalized_url").sortWithinPartitions(
                "hostname", "normalized_url"
            ),
            "links",
            import_id,
        )
        numbers |= {"inserted": indexed["rows"]}
        numbers |= {"duplicate": numbers["discovered"] - numbers["invalid"] - numbers["inserted"]}
        self._tell("INDEXED", numbers)
        added = library.of_imports("links", [import_id])
        cells = filters.cells_for(indexed["rows"])

        def resighted() -> None:
            library.write_part(first.join(again, "normalized_url", "left_semi"), "resightings", import_id)
            library.write_part(host_counts(added, library.of_imports("resightings", [import_id])), "host_counts", import_id)

        def sketched() -> None:
            domains = added.select("registered_domain").where("registered_domain <> ''").distinct()
            sketch = domains.agg(F.hll_sketch_agg("registered_domain").alias("registered_domains"))
            library.write_part(sketch, "sketches", import_id)

        def filtered() -> None:
            library.write_part(filters.filter_cells(added, "normalized_url", max(cells, 1)), "url_filters", import_id)

        def hosts() -> int:
            found = library.new_hosts(added.select("hostname").distinct(), last)
            return library.write_part(found, "hosts", import_id)["rows"]

        # small jobs that need nothing of each other
        with ThreadPoolExecutor(max_workers=4) as pool:
            new_hosts = pool.submit(hosts)
            waiting = [pool.submit(f) for f in (resighted, sketched, filtered)]
            waiting.append(pool.submit(library.write_part, file_trigrams(added), "trigrams", import_id))
            for written_part in waiting:
                written_part.result()
            new_hosts = new_hosts.result()
        inserted = added.groupBy("source_id").agg(F.count(F.lit(1)).alias("urls_inserted"))
        seen = written.groupBy("source_id").agg(
            F.count(F.lit(1)).alias("urls_discovered"),
            F.count_if(~F.col("valid")).alias("invalid_urls"),
        )
        zero = F.lit(0).cast("long")
        sources = (
            origin.join(seen, "source_id", "left")
            .join(inserted, "source_id", "left")
            .select(
                *origin.columns,
                at.alias("imported_at"),
                F.lit("complete").alias("status"),
                F.coalesce("urls_discovered", zero).alias("urls_discovered"),
                F.coalesce("urls_inserted", zero).alias("urls_inserted"),
                F.coalesce("invalid_urls", zero).alias("invalid_urls"),
            )
            .withColumn("duplicates", F.expr("urls_discovered - urls_inserted - invalid_urls"))
        )
        library.write_part(sources, "sources", import_id)
        of_import = library.table("sources", import_id).where(F.col("import_id") == import_id)
        report = import_report(of_import, added).first().asDict()
        state = {
            "last_source_id": of_import.agg(F.coalesce(F.max("source_id"), F.lit(before["last_source_id"]))).first()[0],
            "last_link_id": before["last_link_id"] + indexed["rows"],
            "unique_urls": before["unique_urls"] + report["unique_urls"],
            "unique_domains": before["unique_domains"] + new_hosts,
            "http_urls": before["http_urls"] + report["http_urls"],
            "https_urls": before["https_urls"] + report["https_urls"],
        }
        library.commit(import_id, at, stream, batch_id, state, cells)
        report |= {name: state[name] for name in report if name in state}
        report["files_skipped"] = skipped
        return ImportResult(import_id, report)
