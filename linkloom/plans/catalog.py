"""The registered queries: every operator over the whole shared test tables."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.extract import extract_urls, url_matches, with_stripped
from linkloom.functions.text import has_extension, safe_directory
from linkloom.functions.unwrap import outward, unwrap_href
from linkloom.functions.urls import normalize_urls
from linkloom.operators import links as L
from linkloom.operators import reports as R
from linkloom.operators import search as S
from linkloom.operators import workqueue as Q
from linkloom.operators.hosts import with_registered_domain
from linkloom.operators.occurrences import READING_ORDER, occurrences
from linkloom.plans import corpus, export
from linkloom.plans.importer import Importer
from linkloom.plans.library import Library, sized, utc
from linkloom.session import shared_folder, spread, stage, stage_counted
from linkloom.sources.csv import csv_dialects, scan_cells, scan_csv
from linkloom.sources.files import discover_files, fingerprints
from linkloom.sources.pages import distinct_links, page_links
from linkloom.sources.tables import listed_urls, new_files
from linkloom.sources.text import scan_text
from linkloom.streaming.drop_folder import watch

OCCURRENCE_COLUMNS = (
    "source_id", "source_file", "source_row", "col_idx", "source_column", "seen_at", "match_idx", "raw_url",
    "normalized_url", "scheme", "hostname", "port", "path", "query", "fragment", "valid", "reason",
)
LINK_COLUMNS = (
    "link_id", "normalized_url", "original_url", "scheme", "hostname", "registered_domain", "port", "path",
    "query", "fragment", "first_seen", "last_seen", "source_file", "source_row", "source_column",
)
# What the places of links are made of.
PLACE_COLUMNS = ("normalized_url", "source_id", "source_row", "source_column", "valid")
# What a list of links shows of their sightings.
LISTED = tuple(c for c in S.PAGE_COLUMNS if c in L.SIGHTING_COLUMNS)


def _occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return occurrences(corpus.records(spark, sf))


def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences without the parts of their URLs, which follow from those that are different."""
    return occurrences(corpus.records(spark, sf), parts=False)


def _links(spark: SparkSession, sf: str, *told: str) -> DataFrame:
    """Links, with those columns of their sightings that are told."""
    return L.links(_normalized(spark, sf), wanted=told)


def _ids(spark: SparkSession, sf: str, *told: str, found: DataFrame | None = None) -> DataFrame:
    """Numbered URLs without their parts, with those columns of their sightings that are told."""
    found = _normalized(spark, sf) if found is None else found
    first = L.first_sightings(found, (*READING_ORDER, *told))
    return L.with_link_ids(first, wanted=told)


def _numbered(spark: SparkSession, sf: str, *told: str, found: DataFrame | None = None) -> DataFrame:
    """Numbered links, with those columns of their sightings that are told."""
    return L.with_url_parts(_ids(spark, sf, *told, found=found))


def _queued(spark: SparkSession, sf: str, queue: DataFrame) -> DataFrame:
    """The numbered links that are in the queue: only they are split into parts."""
    return L.with_url_parts(Q.queued_links(_ids(spark, sf), queue))


def _settled(few: DataFrame) -> DataFrame:
    """The queue, or few URLs, as a written table, which is broadcast if it is small: links are far more."""
    written, told = stage_counted(few)
    return sized(written, told["rows"])


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    return _settled(Q.current_queue(corpus.queue_events(spark, sf)))


def _listed(spark: SparkSession, sf: str, ids: DataFrame) -> DataFrame:
    """Numbered URLs with their parts, registered domain and the status the queue gives them."""
    return Q.with_status(with_registered_domain(L.with_url_parts(ids)), _queue(spark, sf))


def _link_list(spark: SparkSession, sf: str, *told: str) -> DataFrame:
    """Numbered links with registered domain and the status the queue gives them."""
    return _listed(spark, sf, _ids(spark, sf, *told))


def _counted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences and first sightings as counters of sources need them."""
    found = corpus.occurrence_table(spark, sf, "source_id", "normalized_url", "valid")
    return found, L.first_sightings(found, ("source_id",))


def _source_table(spark: SparkSession, sf: str, found: DataFrame, first: DataFrame) -> DataFrame:
    return corpus.source_table(corpus.records(spark, sf, dealt=False), found, first)


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return _source_table(spark, sf, *_counted(spark, sf))


def _port_as_text(df: DataFrame) -> DataFrame:
    """Ports as text in results: a whole number that may be NULL is no whole number everywhere."""
    return df.withColumn("port", F.col("port").cast("string"))


def _result_links(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.derived(spark, sf, corpus.RESULT_LINKS, "pages")


# Sources and scalar operators ------------------------------------------------------------------


def discover(spark, sf):
    """Files of a folder tree; the folder names tell them apart."""
    files = discover_files(spark, corpus.text_files(spark, sf), recursive=True)
    return files.select(
        corpus.label_of(F.col("path")).alias("label"),
        F.substring_index("file_name", ".", -1).alias("suffix"),
        "file_size",
    )


def scan_txt(spark, sf):
    found = scan_text(spark, corpus.text_files(spark, sf))
    return found.select(
        corpus.label_of(F.col("path")).alias("label"), "source_row", "match_idx", "raw_url"
    )


def scan_csv_urls(spark, sf):
    found = scan_csv(spark, corpus.csv_files(spark, sf))
    return found.select(corpus.label_of(F.col("path")).alias("label"), "source_row", "col_idx", "raw_url")


def scan_csv_cells(spark, sf):
    """Records and characters of every column of every file."""
    cells = scan_cells(spark, corpus.csv_files(spark, sf))
    return cells.groupBy(corpus.label_of(F.col("path")).alias("label"), "col_idx").agg(
        F.count_distinct("source_row").alias("records"), F.sum(F.length("text")).alias("chars")
    )


def csv_delimiter_profile(spark, sf):
    """Delimiter and quote of files of four dialects."""
    return csv_dialects(spark, corpus.csv_files(spark, sf)).select(
        corpus.label_of(F.col("path")).alias("label"), "delimiter", "quote"
    )


def file_fingerprints(spark, sf):
    """Content digests of the text files."""
    folder = corpus.text_files(spark, sf)
    return fingerprints(spark, folder).select(
        corpus.label_of(F.col("path")).alias("label"), "file_size", "file_hash"
    )


def _document_files(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    return documents.select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.sha2("text", 256).alias("file_hash"),
        F.octet_length("text").cast("long").alias("file_size"),
    )


def document_fingerprints(spark, sf):
    return _document_files(spark, sf).select("doc_id", "file_size", "file_hash")


def new_files_only(spark, sf):
    """Documents as files; those labelled good are imported already."""
    files = _document_files(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    known = files.join(labels, "doc_id", "left_semi").withColumn("status", F.lit("complete"))
    return new_files(files, known, ["doc_id"]).select("doc_id", "path", "file_hash", "file_size")


def ingest_url_table(spark, sf):
    urls = corpus.derived(spark, sf, corpus.URL_LIST, "pages")
    found = listed_urls(urls, "url", "harvest:yahoo:pages")
    return _port_as_text(found.select(*[c for c in OCCURRENCE_COLUMNS if c != "seen_at"]))


def stream_import(spark, sf):
    """Links per host after text files were imported from a drop folder."""
    root = f"{shared_folder(spark)}/linkloom-library-{uuid.uuid4().hex}"
    library = Library(spark, root)
    inbox = corpus.text_files(spark, sf)
    query = watch(Importer(library), inbox, f"{root}-checkpoint", lambda batch: utc("2026-01-01 00:00:00"))
    query.awaitTermination()
    return library.domains().select("hostname", "registered_domain", "link_count")


def _two_lists(spark: SparkSession, sf: str) -> Library:
    """A library after two lists were imported, the second of which has much of the first."""
    library = Library(spark, f"{shared_folder(spark)}/linkloom-library-{uuid.uuid4().hex}")
    importer = Importer(library)
    pages = corpus.derived(spark, sf, corpus.PAGE_LIST, "pages")
    importer.import_list(pages, "url", "pages", utc("2026-01-01 00:00:00"))
    importer.import_list(corpus.derived(spark, sf, corpus.URL_LIST, "pages"), "url", "list", utc("2026-01-02 00:00:00"))
    return library


def import_again(spark, sf):
    """What each of two imports found that have URLs in common."""
    sources = _two_lists(spark, sf).sources()
    return sources.select("source_id", "source_file", "urls_discovered", "urls_inserted", "duplicates", "invalid_urls")


def library_hosts(spark, sf):
    """Hosts folded from what each import left of them."""
    return _two_lists(spark, sf).domains()


def library_search(spark, sf):
    """A search by the trigrams of a library's files."""
    found = _two_lists(spark, sf).search(S.LinkFilter(q="TION", path_contains="/en/"))
    return found.select("link_id", "normalized_url", "source_file", "status")


def library_page(spark, sf):
    """A page of a library's links, of the imports that it takes."""
    page = _two_lists(spark, sf).page(S.LinkFilter(scheme="https"), limit=60, after=101)
    rows = [(i["link_id"], i["normalized_url"], page["next"]) for i in page["items"]]
    return spark.createDataFrame(rows, "link_id long, normalized_url string, next_id long")


def page_links_query(spark, sf):
    pages = corpus.derived(spark, sf, corpus.RESULT_PAGES, "pages")
    return page_links(pages, "page_id").select("page_id", "position", "url")


def harvested_links(spark, sf):
    """The different links of all stored result pages, in the order they are met."""
    pages = corpus.derived(spark, sf, corpus.RESULT_PAGES, "pages")
    return distinct_links(page_links(pages, "page_id"), "page_id")


def extract_urls_query(spark, sf):
    found = extract_urls(corpus.records(spark, sf))
    return found.select("source_id", "source_row", "col_idx", "match_idx", "raw_url")


def strip_url_punctuation(spark, sf):
    matches = corpus.records(spark, sf).select(
        "source_id", "source_row", F.posexplode(url_matches(F.col("text"))).alias("match_idx", "match")
    )
    return with_stripped(matches, "match", "stripped").withColumn("match_idx", F.col("match_idx").cast("long"))


def normalize_urls_query(spark, sf):
    return _port_as_text(_occurrences(spark, sf).select(*OCCURRENCE_COLUMNS))


def invalid_url_reasons(spark, sf):
    """Counts by reason where only https is accepted."""
    found = occurrences(corpus.records(spark, sf), schemes=("HTTPS",))
    return found.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def registered_domains(spark, sf):
    """The corpus's hosts, and each below names that wildcards and exceptions speak of."""
    hosts = _occurrences(spark, sf).where("valid").select("hostname").distinct()
    tails = F.array(*[F.lit(t) for t in (".any.ck", ".www.ck", ".any.kawasaki.jp", ".city.kawasaki.jp")])
    named = F.transform(tails, lambda t: F.concat(F.replace("hostname", F.lit("."), F.lit("-")), t))
    every = hosts.select(F.explode(F.concat(F.array("hostname"), named)).alias("hostname"))
    return with_registered_domain(every, parts=True)


def unwrap_redirects(spark, sf):
    found = _result_links(spark, sf)
    return found.select("page_id", "engine", "href", unwrap_href(F.col("href"), F.col("engine")).alias("url"))


def exclude_search_hosts(spark, sf):
    found = _result_links(spark, sf)
    return found.where(outward(F.col("href")).isNotNull()).select("page_id", "engine", "href")


def export_partition_key(spark, sf):
    names = _links(spark, sf).select(F.concat(F.lit(".."), "hostname", "path").alias("name"))
    return names.select("name", safe_directory(F.col("name")).alias("directory"))


# Links, domains, sources -----------------------------------------------------------------------


def links_query(spark, sf):
    found = _numbered(spark, sf, *[c for c in LINK_COLUMNS if c in L.SIGHTING_COLUMNS])
    return _port_as_text(with_registered_domain(found).select(*LINK_COLUMNS))


def _times(spark: SparkSession, sf: str) -> DataFrame:
    """Links with the times they were seen at, which rise with the reading order of the corpus."""
    return L.sighting_times(_normalized(spark, sf))


def _domains(spark: SparkSession, sf: str) -> DataFrame:
    return L.domains(L.with_url_parts(_times(spark, sf)))


def domains_query(spark, sf):
    return _domains(spark, sf)


def source_counters(spark, sf):
    return L.source_counters(*_counted(spark, sf))


def link_sources(spark, sf):
    return L.link_sources(corpus.occurrence_table(spark, sf, *PLACE_COLUMNS))


def new_links_only(spark, sf):
    """What the order logs add to a library of the notes and documents."""
    told = ("original_url", "source_id", "source_row")
    found = corpus.occurrence_table(spark, sf, "normalized_url", "raw_url", *READING_ORDER, "valid")
    known = L.first_sightings(found.where(F.col("source_id") < 100), ())
    orders = L.first_sightings(found.where(F.col("source_id") >= 100), told)
    return L.new_links(orders, known).select("normalized_url", "original_url", "source_id", "source_row")


def domain_source_counts(spark, sf):
    return L.domain_sources(_occurrences(spark, sf))


def url_source_history(spark, sf):
    found = corpus.occurrence_table(spark, sf, *PLACE_COLUMNS, "source_file", "seen_at")
    sources = found.select("source_id", "source_file", F.col("seen_at").alias("imported_at")).distinct()
    return S.source_history(L.link_sources(found), sources)


def source_detail(spark, sf):
    return S.source_summary(corpus.occurrence_table(spark, sf, *PLACE_COLUMNS, "hostname"))


def import_report(spark, sf):
    found, first = _counted(spark, sf)
    return R.import_report(_source_table(spark, sf, found, first), L.with_url_parts(first))


# Reports ---------------------------------------------------------------------------------------


def scheme_counts(spark, sf):
    return R.scheme_counts(L.with_url_parts(_times(spark, sf)))


def top_domains(spark, sf):
    return R.top_domains(L.domain_counts(_occurrences(spark, sf)))


def library_totals(spark, sf):
    sources = corpus.records(spark, sf).select("source_id").distinct()
    return R.library_totals(_domains(spark, sf), sources, _queue(spark, sf))


def registered_domain_estimate(spark, sf):
    """The exact count, and whether the sketch comes within a tenth of it."""
    found = _domains(spark, sf)
    estimate = R.registered_domain_count(found, approximate=True).select(F.col("registered_domains").alias("estimate"), F.lit(1).alias("one"))
    exact = R.registered_domain_count(found).withColumn("one", F.lit(1))
    off = F.abs(F.col("estimate") - F.col("registered_domains"))
    return exact.join(estimate, "one").select("registered_domains", (off <= 0.1 * F.col("registered_domains") + 1).alias("estimate_fits"))


def tld_breakdown(spark, sf):
    return R.tld_breakdown(L.domain_counts(_occurrences(spark, sf)))


def library_growth(spark, sf):
    return R.library_growth(_times(spark, sf))


def source_activity(spark, sf):
    return R.source_activity(_sources(spark, sf))


def sources_list(spark, sf):
    return R.sources_list(_sources(spark, sf))


def last_import(spark, sf):
    return R.last_import(_sources(spark, sf))


def recent_activity(spark, sf):
    """Import events and the additions to the queue, newest forty."""
    imports = R.import_activity(_sources(spark, sf))
    queued = _queue(spark, sf).select(
        F.lit("HARVEST QUEUED").alias("event"),
        F.concat(F.lit("link "), F.col("link_id").cast("string")).alias("detail"),
        F.col("added_at").alias("created_at"),
        F.col("queue_id").alias("seq"),
    )
    return R.recent_activity(imports.unionByName(queued))


# Search and paging -----------------------------------------------------------------------------


def search_links(spark, sf):
    """Several conditions at once, all matches."""
    wanted = S.LinkFilter(
        q="Example.CO", registered_domain="example.com", scheme="HTTPS", status="DISCOVERED", path_contains="rders/1"
    )
    return S.search(_link_list(spark, sf, *LISTED), wanted).select(*S.PAGE_COLUMNS)


def search_total(spark, sf):
    wanted = S.LinkFilter(q="_1", scheme="http", extension="pdf")
    return S.search(_links(spark, sf, "source_file"), wanted).agg(F.count(F.lit(1)).alias("total"))


def search_simple(spark, sf):
    return S.search_simple(_links(spark, sf), "shop%.EXAMPLE.com/orders/2")


def links_by_extension(spark, sf):
    found = _links(spark, sf)
    return found.where(
        has_extension(F.col("path"), "P_F") | has_extension(F.col("path"), ".html")
    ).select("normalized_url", "path")


def links_in_date_range(spark, sf):
    wanted = S.LinkFilter(date_from="2023-06-01", date_to="2024-10-23")
    return S.search(_links(spark, sf, "first_seen"), wanted).select("normalized_url", "first_seen")


def links_page(spark, sf):
    """The second page of a source's kind of links: ids below 5000, newest first."""
    return S.marked_page(S.newest_links(_link_list(spark, sf, *LISTED).select(*S.PAGE_COLUMNS), 50, after=5000), 50)


def domains_page(spark, sf):
    return S.ranked_domains(_domains(spark, sf), 50, 25)


def domains_by_tld(spark, sf):
    found = stage(_domains(spark, sf))
    other = S.filter_domains(found, tld="other").withColumn("filter", F.lit("other"))
    gov = S.filter_domains(found, q="EXAMPLE", tld=".GOV").withColumn("filter", F.lit(".gov"))
    return other.unionByName(gov)


def domain_links(spark, sf):
    return S.of_domain(_links(spark, sf), "example.gov").select("normalized_url", "hostname")


def domain_links_page(spark, sf):
    return S.domain_links(_links(spark, sf), "example.gov", 500, 40)


def source_links(spark, sf):
    """The links of a source of notes, newest first; only its own are split into parts."""
    found = corpus.occurrence_table(spark, sf, *PLACE_COLUMNS, "col_idx", "match_idx")
    places = L.link_sources(found)
    own = _settled(places.where(F.col("source_id") == 3).select("normalized_url").distinct())
    ids = _ids(spark, sf, found=found).join(own, "normalized_url", "left_semi")
    return S.source_links(places, _listed(spark, sf, ids), 3, 120, 5)


def _labelled_ids(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").select((F.col("doc_id") + 1).alias("link_id"))


def url_detail(spark, sf):
    """Detail of the links whose numbers are in a table, with their queue entry."""
    found = S.link_detail(_numbered(spark, sf, "last_seen"), _labelled_ids(spark, sf), _queue(spark, sf))
    return found.select(
        "link_id", "normalized_url", "last_seen", "queue_status", "queue_priority", "queue_added_at"
    )


# Queue -----------------------------------------------------------------------------------------


def queue_list(spark, sf):
    queue = _queue(spark, sf)
    return Q.queue_list(queue, _queued(spark, sf, queue), limit=None)


def queued_links(spark, sf):
    return Q.queued_links(_ids(spark, sf), _queue(spark, sf)).select("link_id", "normalized_url")


def queue_after_add(spark, sf):
    """The queue after all links whose numbers are in a table were added."""
    events = corpus.queue_events(spark, sf)
    at, seq = utc("2025-01-01 00:00:00"), F.col("link_id") + F.lit(10**12)
    added = Q.add_events(_queue(spark, sf), _ids(spark, sf), _labelled_ids(spark, sf), F.lit("low"), at, seq)
    return Q.current_queue(events.unionByName(added)).drop("queue_id")


def queue_after_remove(spark, sf):
    """The queue after every entry of high priority was removed."""
    events = corpus.queue_events(spark, sf)
    queue = _queue(spark, sf)
    high = queue.where(F.col("priority") == "HIGH").select("queue_id")
    removed = Q.remove_events(queue, high, utc("2025-01-01 00:00:00"), F.col("queue_id") + F.lit(10**12))
    return Q.current_queue(events.unionByName(removed))


def queue_after_clear(spark, sf):
    """Queued and not queued links after the queue was cleared and refilled from a table."""
    events = corpus.queue_events(spark, sf)
    at = utc("2025-01-01 00:00:00")
    cleared = events.unionByName(Q.clear_event(events, at))
    links = _ids(spark, sf)
    added = Q.add_events(
        _settled(Q.current_queue(cleared)), links, _labelled_ids(spark, sf), F.lit("HIGH"), at, F.col("link_id") + F.lit(10**12)
    )
    queue = _settled(Q.current_queue(cleared.unionByName(added)))
    return Q.with_status(links, queue).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# Exports ---------------------------------------------------------------------------------------


def export_all(spark, sf):
    return export.export_rows(_links(spark, sf, "original_url", "first_seen", "source_file"))


def export_domain(spark, sf):
    return S.of_domain(_links(spark, sf), "en.docs.example.org").select(F.col("normalized_url").alias("url"))


def export_by_domain(spark, sf):
    return export.by_directory(_links(spark, sf, "original_url", "first_seen"))


def export_metadata(spark, sf):
    return export.domain_metadata(_domains(spark, sf))


def export_selected(spark, sf):
    chosen = export.chosen_links(with_registered_domain(_numbered(spark, sf, "source_file")), "selected", link_ids=_labelled_ids(spark, sf))
    return export.export_columns(chosen)


def export_queue(spark, sf):
    chosen = export.chosen_links(_ids(spark, sf), "queue", queue=_queue(spark, sf))
    return export.export_columns(chosen, domain=False, source=False)


def export_columns(spark, sf):
    chosen = export.chosen_links(_links(spark, sf, *L.SIGHTING_COLUMNS), "source", source="docs-src1.csv")
    return export.export_columns(chosen, original=True, timestamps=True)


def export_written(spark, sf):
    """A full export written as CSV, in compressed parts, and read back."""
    folder = f"{shared_folder(spark)}/linkloom-export-{uuid.uuid4().hex}"
    first = L.first_sightings(_normalized(spark, sf), [c for c in export.ALL_COLUMNS if c in L.SIGHTING_COLUMNS])
    export.export_all(L.described(export.in_export_order(first)), folder, ordered=True, compression="gzip")
    written = spark.read.option("header", True).option("escape", '"').csv(folder)
    return written.na.fill("", ["path", "query"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "discover_files": discover,
    "scan_txt": scan_txt,
    "scan_csv_urls": scan_csv_urls,
    "scan_csv_cells": scan_csv_cells,
    "csv_delimiter_profile": csv_delimiter_profile,
    "text_file_fingerprints": file_fingerprints,
    "file_fingerprints": document_fingerprints,
    "new_files_only": new_files_only,
    "ingest_url_table": ingest_url_table,
    "stream_import": stream_import,
    "import_again": import_again,
    "library_hosts": library_hosts,
    "library_search": library_search,
    "library_page": library_page,
    "page_links": page_links_query,
    "harvested_links": harvested_links,
    "extract_urls": extract_urls_query,
    "strip_url_punctuation": strip_url_punctuation,
    "normalize_urls": normalize_urls_query,
    "invalid_url_reasons": invalid_url_reasons,
    "registered_domains": registered_domains,
    "unwrap_redirects": unwrap_redirects,
    "exclude_search_hosts": exclude_search_hosts,
    "export_partition_key": export_partition_key,
    "links": links_query,
    "domains": domains_query,
    "source_counters": source_counters,
    "link_sources": link_sources,
    "new_links_only": new_links_only,
    "domain_source_counts": domain_source_counts,
    "url_source_history": url_source_history,
    "source_detail": source_detail,
    "import_report": import_report,
    "scheme_counts": scheme_counts,
    "top_domains": top_domains,
    "library_totals": library_totals,
    "registered_domain_estimate": registered_domain_estimate,
    "tld_breakdown": tld_breakdown,
    "library_growth": library_growth,
    "source_activity": source_activity,
    "sources_list": sources_list,
    "last_import": last_import,
    "recent_activity": recent_activity,
    "search_links": search_links,
    "search_total": search_total,
    "search_simple": search_simple,
    "links_by_extension": links_by_extension,
    "links_in_date_range": links_in_date_range,
    "links_page": links_page,
    "domains_page": domains_page,
    "domains_by_tld": domains_by_tld,
    "domain_links": domain_links,
    "domain_links_page": domain_links_page,
    "source_links": source_links,
    "url_detail": url_detail,
    "queue_list": queue_list,
    "queued_links": queued_links,
    "queue_after_add": queue_after_add,
    "queue_after_remove": queue_after_remove,
    "queue_after_clear": queue_after_clear,
    "export_all": export_all,
    "export_domain": export_domain,
    "export_by_domain": export_by_domain,
    "export_metadata": export_metadata,
    "export_selected": export_selected,
    "export_queue": export_queue,
    "export_columns": export_columns,
    "export_written": export_written,
}
