import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from linkloom.operators.links import domains
from linkloom.operators.search import LinkFilter, fetch_page, search
from linkloom.plans import export
from linkloom.plans.importer import Importer
from linkloom.plans.library import Library, utc
from linkloom.streaming.drop_folder import watch

A = (
    "Opening hours: http://museum.example.org/hours?d=mo;\n"
    "http://museum.example.org/hours?d=mo HTTP://Museum.Example.org/hours?d=mo\n"
    "map (https://maps.example.net/a_(b)) http://museum.example.org/\n"
)
B = 'no,link\n1,https://plans.example.gov/p.csv\n2,"https://example.gov/s.pdf; https://example.gov/s.pdf"\n3,none\n'
T1, T2, T3 = "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z", "2026-01-03T00:00:00Z"


def listed(library):
    return [
        (r.link_id, r.normalized_url, r.original_url, str(r.first_seen)[:10], str(r.last_seen)[:10], r.source_file, r.source_row)
        for r in library.links(last_seen=True).orderBy("link_id").collect()
    ]


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(A)
    (folder / "copy of [a].txt").write_text(A)
    (folder / "b.csv").write_text(B)
    (folder / "c.md").write_text("https://not.imported/")
    return folder


def test_import_skip_and_grow(spark, tmp_path, inbox):
    library = Library(spark, str(tmp_path / "lib"))
    importer = Importer(library)
    first = importer.import_path(str(inbox), utc(T1)).report
    assert (first["files_processed"], first["files_skipped"]) == (2, 1)
    assert (first["urls_discovered"], first["duplicates"], first["unique_urls"], first["unique_domains"]) == (8, 3, 5, 4)
    assert (first["http_urls"], first["https_urls"], first["invalid_urls"]) == (2, 3, 0)

    again = importer.import_path(str(inbox), utc(T2)).report
    assert (again["files_processed"], again["files_skipped"], again["unique_urls"]) == (0, 3, 5)

    (inbox / "z%41 ü[x].txt").write_text("http://museum.example.org/ http://new.org\nhttp://h:99999/ http://straße.de/x")
    third = importer.import_path(str(inbox), utc(T3)).report
    assert (third["files_processed"], third["urls_discovered"], third["duplicates"], third["invalid_urls"]) == (1, 4, 1, 1)

    urls = spark.createDataFrame([(1, "https://example.gov/s.pdf"), (2, "https://example.gov/new.pdf")], "position int, u string")
    harvest = importer.import_list(urls, "u", "harvest:yahoo:plans", utc(T3)).report
    assert (harvest["urls_discovered"], harvest["duplicates"], harvest["unique_urls"]) == (2, 1, 8)

    rows = listed(library)
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert rows[2] == (3, "http://museum.example.org/", "http://museum.example.org/", "2026-01-01", "2026-01-03", "a.txt", 3)
    assert rows[4][1:6] == ("https://example.gov/s.pdf", "https://example.gov/s.pdf", "2026-01-01", "2026-01-03", "b.csv")
    assert rows[5][1] == "http://new.org" and rows[5][5] == "z%41 ü[x].txt"
    assert rows[7][5:] == ("harvest:yahoo:plans", 2)
    assert [r.detail for r in library.activity().collect()] == ["harvest:yahoo:plans +8", "z%41 ü[x].txt +7", "b.csv +5", "a.txt +3"]
    hosts = {r.hostname: (r.registered_domain, r.link_count) for r in library.domains().collect()}
    assert hosts["example.gov"] == ("example.gov", 2) and hosts["plans.example.gov"] == ("example.gov", 1)

    page = fetch_page(library.links(), LinkFilter(q="example.gov", extension="pdf"), include_total=True)
    assert page["total"] == 2 and [i["link_id"] for i in page["items"]] == [8, 5]


def test_two_imports_equal_one(spark, tmp_path):
    texts = {f"f{i}.txt": "\n".join(f"http://h{(i * j) % 7}.com/{(i + j) % 11}" for j in range(20)) for i in range(4)}
    results = []
    for split in (2, 4):
        folder = tmp_path / f"in{split}"
        folder.mkdir()
        library = Library(spark, str(tmp_path / f"lib{split}"))
        for n, (name, text) in enumerate(texts.items(), 1):
            (folder / name).write_text(text)
            if n % split == 0:
                Importer(library).import_path(str(folder), utc(T1))
        results.append((listed(library), sorted(tuple(r)[:-1] for r in library.sources().drop("file_path", "duplicates").collect())))
    assert results[0] == results[1]


def test_failed_import_leaves_nothing(spark, tmp_path, inbox, monkeypatch):
    library = Library(spark, str(tmp_path / "lib"))
    importer = Importer(library)
    with monkeypatch.context() as patch:
        patch.setattr(Library, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            importer.import_path(str(inbox), utc(T1))
    assert library.links().count() == 0 and library.occurrences().count() == 0
    assert importer.import_path(str(inbox), utc(T2)).report["unique_urls"] == 5
    assert library.occurrences().count() == 8


def test_large_imports_meet_by_shuffles(spark, tmp_path, inbox, monkeypatch):
    results = []
    for rows in (100_000, 0):
        monkeypatch.setattr("linkloom.plans.library.BROADCAST_ROWS", rows)
        library = Library(spark, str(tmp_path / f"lib{rows}"))
        reports = [Importer(library).import_path(str(inbox), utc(T1)).report]
        urls = spark.createDataFrame([(1, "https://example.gov/s.pdf"), (2, "http://fresh.test/")], "position int, u string")
        reports.append(Importer(library).import_list(urls, "u", "list", utc(T2)).report)
        results.append((listed(library), reports))
    assert results[0] == results[1]


def test_empty_and_hidden_files_of_an_import(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in (("e.txt", ""), ("_h.txt", "http://hidden.test/"), ("f.txt", "http://f.test/"), ("g.csv", "")):
        (folder / name).write_text(text)
    library = Library(spark, str(tmp_path / "lib"))
    report = Importer(library).import_path(str(folder), utc(T1)).report
    # both empty files have one content; the hidden one cannot be read
    assert (report["files_processed"], report["files_skipped"], report["unique_urls"]) == (2, 2, 1)
    names = [(r.source_file, r.file_size, r.urls_discovered) for r in library.sources().orderBy("source_id").collect()]
    assert names == [("e.txt", 0, 0), ("f.txt", 14, 1)]
    assert Importer(library).import_path(str(folder), utc(T2)).report["files_skipped"] == 4


def test_totals_follow_the_library(spark, tmp_path, inbox):
    library = Library(spark, str(tmp_path / "lib"))
    Importer(library).import_path(str(inbox), utc(T1))
    (inbox / "n.txt").write_text("http://plans.example.gov/p.csv https://new.test/ http://new.test/ https://example.gov/s.pdf")
    report = Importer(library).import_path(str(inbox), utc(T2)).report
    links = library.links()
    assert report["unique_urls"] == links.count() == 8
    assert report["unique_domains"] == links.select("hostname").distinct().count() == 5
    assert report["http_urls"] == links.where("scheme = 'http'").count()
    assert report["https_urls"] == links.where("scheme = 'https'").count()


def test_an_import_does_not_shuffle_the_library(spark, tmp_path, inbox, monkeypatch):
    library = Library(spark, str(tmp_path / "lib"))
    Importer(library).import_path(str(inbox), utc(T1))
    plans = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(self._df), write(self, *a, **k))[1])
    (inbox / "n.txt").write_text("http://new.test/ https://example.gov/s.pdf")
    Importer(library).import_path(str(inbox), utc(T2))
    read = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    of_links = [p for p in read if re.search(r"Location: InMemoryFileIndex.*lib/links", p) and "Exchange hashpartitioning(normalized_url" in p]
    assert not of_links


def grown(spark, tmp_path, name="lib", imports=6):
    """A library of several imports, each with links of its own and one that all share."""
    library = Library(spark, str(tmp_path / name))
    importer = Importer(library)
    for i in range(imports):
        urls = [(n, f"http://h{i}.test/{n}") for n in range(4)] + [(9, "http://all.test/")]
        importer.import_list(spark.createDataFrame(urls, "position int, u string"), "u", f"list{i}", utc(T1))
    return library


def opened(df):
    return sorted({int(n) for f in df.inputFiles() for n in re.findall("/links/import_id=([0-9]+)", f)})


def test_only_imports_whose_filter_fires_are_read(spark, tmp_path, monkeypatch):
    library = grown(spark, tmp_path)
    urls = spark.createDataFrame([(u,) for u in ("http://h2.test/1", "http://h4.test/0", "http://none.test/", "http://h4.test/")], "normalized_url string")
    known = library.known_links(urls, 6, 4)
    assert opened(known) == [3, 5]
    assert sorted(r[0] for r in known.collect()) == ["http://h2.test/1", "http://h4.test/0"]
    assert library.known_links(urls.where("normalized_url LIKE '%none%'"), 6, 1).collect() == []
    # as of an import nothing later is known
    assert [r[0] for r in library.known_links(urls, 4, 4).collect()] == ["http://h2.test/1"]
    # wrong answers of the filters open every import and change nothing else
    read = Library._read
    full = lambda self, table: read(self, table).withColumn("bits", F.lit(-1).cast("long")) if table == "url_filters" else read(self, table)
    monkeypatch.setattr(Library, "_read", full)
    many = spark.createDataFrame([(f"http://h{i}.test/{n}",) for i in range(9) for n in range(9)], "normalized_url string")
    known = library.known_links(many, 6, 81)
    assert opened(known) == [1, 2, 3, 4, 5, 6]
    assert sorted(r[0] for r in known.collect()) == sorted(f"http://h{i}.test/{n}" for i in range(6) for n in range(4))


def test_libraries_without_filters(spark, tmp_path, monkeypatch):
    """Imports that left no filter, as by an older version, are all read."""
    commit, table = Library.commit, Library.table
    with monkeypatch.context() as patch:
        patch.setattr(Library, "commit", lambda self, *a: commit(self, *a[:-1], None))
        patch.setattr("linkloom.plans.importer.filters.filter_cells", lambda df, c, n: df.sparkSession.createDataFrame([], "cells long, cell long, bits long"))
        patch.setattr(Library, "new_hosts", lambda self, hosts, until: hosts.where("false"))
        library = grown(spark, tmp_path, imports=2)
    report = Importer(library).import_list(
        spark.createDataFrame([(1, "http://h1.test/1"), (2, "http://h1.test/new"), (3, "http://fresh.test/")], "position int, u string"), "u", "l", utc(T2)
    ).report
    assert (report["duplicates"], report["unique_urls"]) == (1, 11)
    assert opened(library.known_links(spark.createDataFrame([("http://h0.test/1",)], "normalized_url string"), 3, 1)) == [1, 2]
    assert {r.hostname for r in library.table("hosts").collect()} == {"fresh.test"}
    with monkeypatch.context() as patch:
        patch.setattr(Library, "table", lambda self, name, until=None: table(self, name, until).where("import_id > 2") if name == "host_counts" else table(self, name, until))
        assert sorted(map(tuple, library.domains().collect())) == sorted(map(tuple, domains(library.links(last_seen=True)).collect()))


def test_a_page_reads_the_imports_it_needs(spark, tmp_path, monkeypatch):
    library = grown(spark, tmp_path)
    read, reads = Library.of_imports, []

    def noted(self, name, ids):
        df = read(self, name, ids)
        if name == "links":
            reads.append(opened(df))
        return df

    monkeypatch.setattr(Library, "of_imports", noted)
    whole, after = [], None
    while True:
        page = library.page(limit=3, after=after)
        want = fetch_page(library.links(), LinkFilter(), 3, after)
        assert page["items"] == want["items"] and page["next"] == want["next"] and page["has_more"] == want["has_more"]
        whole += [i["link_id"] for i in page["items"]]
        after = page["next"]
        if not page["has_more"]:
            break
    assert whole == list(range(25, 0, -1))
    assert reads[0] == [6] and max(map(len, reads)) <= 2
    reads.clear()
    assert library.page(limit=4, after=6)["items"][0]["link_id"] == 5
    assert reads == [[1]]
    reads.clear()
    found = library.page(LinkFilter(domain="h0.test"), limit=2, include_total=True)
    assert [i["link_id"] for i in found["items"]] == [4, 3] and found["total"] == 4
    assert reads == [[6], [4, 5], [1, 2, 3]]
    assert library.page(limit=3, offset=2)["items"] == fetch_page(library.links(), limit=3, offset=2)["items"]
    assert Library(spark, str(tmp_path / "none")).page()["items"] == []


def test_totals_and_hosts_without_the_links(spark, tmp_path, monkeypatch):
    """Hosts are folded from the sums of the imports: equal to a roll-up of all links, none of which is read."""
    library = grown(spark, tmp_path, imports=3)
    again = spark.createDataFrame([(1, "http://h0.test/1"), (2, "http://sub.h9.test/x"), (3, "http://h9.test/")], "position int, u string")
    Importer(library).import_list(again, "u", "late", utc(T3))
    want = sorted(tuple(r) for r in domains(library.links(last_seen=True)).collect())
    found = library.domains()
    assert not [f for f in found.inputFiles() if "/links/" in f]
    assert sorted(tuple(r) for r in found.collect()) == want
    assert [str(r.last_seen)[:10] for r in found.where("hostname = 'h0.test'").collect()] == ["2026-01-03"]
    totals = library.totals()
    assert totals == {"total_urls": 15, "total_domains": 6, "registered_domains": 6, "source_files": 4, "queued": 0}
    assert library.registered_domain_estimate() == 6
    assert Library(spark, str(tmp_path / "none")).registered_domain_estimate() == 0


def test_search_opens_files_that_may_match(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"))
    importer = Importer(library)
    for name, urls in (
        ("alpha", ["http://one.test/Museum/map.PDF?q=1", "http://one.test/_x%41/ü"]),
        ("beta", ["http://two.test/museum", "http://two.test/opening"]),
        ("gamma", ["http://three.test/a"]),
    ):
        rows = spark.createDataFrame(list(enumerate(urls)), "position int, u string")
        importer.import_list(rows, "u", name, utc(T1))
    cases = {
        LinkFilter(q="MUSEUM"): [1, 2], LinkFilter(q="m_seum/%pdf"): [1], LinkFilter(q="two.t", path_contains="open"): [2],
        LinkFilter(q="gamma"): [3], LinkFilter(q="nowhere"): [], LinkFilter(q="/ü"): [1], LinkFilter(q="xy"): [1, 2, 3],
        LinkFilter(extension="pdf"): [1, 2, 3], LinkFilter(q="%41/"): [1], LinkFilter(path_contains="museum%"): [1, 2],
    }
    for conditions, imports in cases.items():
        found = library.search(conditions)
        assert opened(found) == imports, conditions
        want = search(library.links(), conditions)
        assert sorted(r.link_id for r in found.collect()) == sorted(r.link_id for r in want.collect()), conditions
    assert library.search(LinkFilter(q="MUSEUM")).count() == 2


def test_progress_in_numbers(spark, tmp_path, inbox):
    """The numbers of an import come while it writes, and agree with its report."""
    told = []
    importer = Importer(Library(spark, str(tmp_path / "lib")), progress=lambda step, numbers: told.append((step, dict(numbers))))
    (inbox / "bad.txt").write_text("http://h:99999/ http://museum.example.org/")
    report = importer.import_path(str(inbox), utc(T1)).report
    assert told == [
        ("FILES", {"files": 3, "files_skipped": 1}),
        ("SCANNED", {"discovered": 10, "invalid": 1}),
        ("INDEXED", {"discovered": 10, "invalid": 1, "inserted": 5, "duplicate": 4}),
    ]
    assert (report["urls_discovered"], report["duplicates"], report["invalid_urls"], report["unique_urls"]) == (10, 4, 1, 5)
    told.clear()
    importer.import_path(str(inbox), utc(T2))
    assert told == [
        ("FILES", {"files": 0, "files_skipped": 4}),
        ("SCANNED", {"discovered": 0, "invalid": 0}),
        ("INDEXED", {"discovered": 0, "invalid": 0, "inserted": 0, "duplicate": 0}),
    ]


def test_page_of_a_source(spark, tmp_path, inbox):
    library = Library(spark, str(tmp_path / "lib"))
    Importer(library).import_path(str(inbox), utc(T1))
    numbers = {r.source_file: r.source_id for r in library.sources().collect()}
    page = library.source_page(numbers["a.txt"], limit=2)
    assert (page["source"]["urls_discovered"], page["domain_count"], page["url_total"]) == (5, 2, 5)
    assert [u["link_id"] for u in page["urls"]] == [3, 2]
    rest = library.source_page(numbers["a.txt"], limit=9, offset=2)
    assert [u["link_id"] for u in rest["urls"]] == [1, 1, 1]
    cells = library.source_page(numbers["b.csv"])
    assert cells["url_total"] == 2 and len(cells["urls"]) == 2
    assert library.source_page(99) is None


def test_a_single_file_of_any_suffix(spark, tmp_path, inbox):
    library = Library(spark, str(tmp_path / "lib"))
    assert Importer(library).import_path(str(inbox / "c.md"), utc(T1)).report["unique_urls"] == 1


def test_drop_folder(spark, tmp_path, inbox):
    batch = Library(spark, str(tmp_path / "batch"))
    Importer(batch).import_path(str(inbox), utc(T1))
    stream = Library(spark, str(tmp_path / "stream"))

    def run(checkpoint):
        query = watch(Importer(stream), str(inbox), str(tmp_path / checkpoint), lambda n: utc(T1))
        query.awaitTermination()

    run("one")
    assert listed(stream) == listed(batch)
    run("one")
    assert stream.last_import() == 1
    # A batch that runs once more, as after a lost checkpoint, is known by its number.
    run("two")
    assert stream.last_import() == 1
    (inbox / "later.txt").write_text("http://later.org/")
    run("one")
    assert stream.links().count() == 6


def test_queue_of_a_library(spark, tmp_path, inbox):
    library = Library(spark, str(tmp_path / "lib"))
    Importer(library).import_path(str(inbox), utc(T1))

    def ids(*numbers):
        return spark.createDataFrame([(n,) for n in numbers], "link_id long")

    assert library.queue_add(ids(1, 3, 1), "HIGH", utc(T1)) == 2
    assert library.queue_add(ids(1, 2), "odd", utc(T2)) == 1
    with pytest.raises(ValueError):
        library.queue_add(ids(99), "LOW", utc(T2))
    entries = {r.link_id: (r.priority, str(r.added_at)[:10]) for r in library.queue().collect()}
    assert entries == {1: ("HIGH", "2026-01-01"), 3: ("HIGH", "2026-01-01"), 2: ("NORMAL", "2026-01-02")}
    assert library.queue_remove(library.queue().where("link_id = 3"), utc(T2)) == 1
    assert {r.link_id: r.status for r in library.links().collect()} == {1: "QUEUED", 2: "QUEUED", 3: "DISCOVERED", 4: "DISCOVERED", 5: "DISCOVERED"}
    folder = str(tmp_path / "queue.txt")
    assert export.export_library(library, folder, utc(T3), "txt", "queue") == 2
    assert sorted(r.value for r in spark.read.text(folder).collect()) == [
        "http://museum.example.org/hours?d=mo", "https://maps.example.net/a_(b)",
    ]
    library.queue_clear(utc(T3))
    assert library.queue().count() == 0
    assert library.queue_add(ids(3), "LOW", utc(T3)) == 1
    details = [(r.event, r.detail) for r in library.activity().collect()]
    assert details[:2] == [("HARVEST QUEUED", "1 urls"), ("EXPORT CREATED", "2 txt")]


def test_exports(spark, tmp_path, inbox, monkeypatch):
    library = Library(spark, str(tmp_path / "lib"))
    Importer(library).import_path(str(inbox), utc(T1))
    links = library.links()
    export.export_all(links, str(tmp_path / "all"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "all").glob("part-*")))
    lines = [l for l in text.splitlines() if not l.startswith("normalized_url,")]
    assert lines[0].startswith("https://example.gov/s.pdf,") and len(lines) == 5
    assert [l.split(",")[3] for l in lines] == sorted(l.split(",")[3] for l in lines)
    assert '2026-01-01T00:00:00Z,a.txt' in text
    export.export_domain(links, "example.gov", str(tmp_path / "dom"), "json")
    urls = [r.url for r in spark.read.json(str(tmp_path / "dom")).orderBy("url").collect()]
    assert urls == ["https://example.gov/s.pdf", "https://plans.example.gov/p.csv"]
    plans = []
    for kind in ("csv", "text", "parquet"):
        own = getattr(DataFrameWriter, kind)
        monkeypatch.setattr(DataFrameWriter, kind, lambda self, *a, own=own, **k: (plans.append(self._df), own(self, *a, **k))[1])
    export.export_directories(links, library.domains(), str(tmp_path / "dirs"))
    ranged = [p for p in plans if "rangepartitioning" in p._jdf.queryExecution().executedPlan().toString()]
    assert len(plans) == 3 and len(ranged) == 1  # one range sort for both formats
    names = sorted(p.name for p in (tmp_path / "dirs" / "links_csv").iterdir() if p.is_dir())
    assert names == [f"directory={h}" for h in ("example.gov", "maps.example.net", "museum.example.org", "plans.example.gov")]
    assert spark.read.json(str(tmp_path / "dirs" / "metadata")).agg(F.sum("link_count")).first()[0] == 5
    chosen = export.chosen_links(links, "selected", link_ids=None)
    assert chosen.count() == 5
    assert export.export_columns(links, False, False, False, False, False).columns == ["url"]


def test_stored_result_pages(spark, tmp_path):
    target = "https://example.gov/a.pdf"
    wrapped = "https://r.search.yahoo.com/x/RU=https%3A%2F%2Fexample.gov%2Fa.pdf/RK=2/RS=z"
    pages = spark.createDataFrame(
        [(2, f'<a href="{target}">x</a><a href="https://b.gov/">', "bing"), (1, f'<a href="{wrapped}">x</a>', "yahoo")],
        "page_id int, html string, engine string",
    )
    library = Library(spark, str(tmp_path / "lib"))
    report = Importer(library).import_pages(pages, "page_id", "harvest:yahoo+bing:quay", utc(T1)).report
    assert (report["urls_discovered"], report["unique_urls"]) == (2, 2)
    rows = library.links().orderBy("link_id").select("normalized_url", "source_row", "source_column").collect()
    assert [tuple(r) for r in rows] == [(target, 1, "harvest"), ("https://b.gov/", 2, "harvest")]
    assert library.activity().first().event == "HARVEST INDEXED"
