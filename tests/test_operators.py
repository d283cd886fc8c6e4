import random
from pathlib import Path

from pyspark.sql import functions as F

from linkloom.operators import links as L
from linkloom.operators import reports as R
from linkloom.operators import search
from linkloom.operators import workqueue as Q
from linkloom.operators.numbering import with_dense_ids
from linkloom.operators.occurrences import READING_ORDER, occurrences
from linkloom.plans import catalog, export
from linkloom.session import spread
from linkloom.sources.tables import new_files

RECORD = "source_id long, source_file string, source_row long, col_idx int, source_column string, seen_at timestamp_ntz, text string"


def records(spark, rows):
    df = spark.createDataFrame(rows, "source_id long, source_row long, col_idx int, source_column string, text string")
    return df.select(
        "source_id", F.concat(F.lit("f"), F.col("source_id").cast("string")).alias("source_file"), "source_row", "col_idx",
        "source_column", F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_dt_interval(CAST(source_id AS INT))").alias("seen_at"), "text",
    )


def random_rows(seed, n=600):
    """A third of all URLs are one URL, in changing spelling."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        urls = [rnd.choice(["http://Hot.com/", "HTTP://hot.COM:80/", f"http://h{rnd.randint(0, 5)}.com/{rnd.randint(0, 30)}", "http://...", "http://x:99999/"]) for _ in range(rnd.randint(0, 4))]
        column = "c" if i % 3 == 0 else None
        rows.append((rnd.randint(1, 5), i, 1 if column else 0, column, " ".join(urls)))
    rnd.shuffle(rows)
    return rows


def replay(rows):
    """The library built one URL at a time."""
    links, counters, places = {}, {}, {}
    for source, row, col, column, text in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        for url in text.split():
            count = counters.setdefault(source, [0, 0, 0, 0])
            count[0] += 1
            norm = url.lower().replace(":80/", "/") if url.lower().startswith("http://hot") else url
            if norm in ("http://...", "http://x:99999/"):
                count[3] += 1
                continue
            if norm in links:
                count[2] += 1
            else:
                count[1] += 1
                links[norm] = (url, source, row)
            place = (norm, source, row, column)
            places[place] = 1 if column else places.get(place, 0) + 1
    return links, counters, places


def test_links_counters_and_places_equal_a_replay(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        found = occurrences(records(spark, rows).repartition(7)).cache()
        links, counters, places = replay(rows)
        first = L.first_sightings(found)
        assert {r.normalized_url: (r.original_url, r.source_id, r.source_row) for r in first.collect()} == links
        numbered = L.with_link_ids(first).orderBy("link_id").collect()
        assert [(r.link_id, r.normalized_url) for r in numbered] == list(enumerate(links, 1))
        got = {r.source_id: [r.urls_discovered, r.urls_inserted, r.duplicates, r.invalid_urls] for r in L.source_counters(found, first).collect()}
        assert got == counters
        seen = {}
        for r in L.link_sources(found).collect():
            key = (r.normalized_url, r.source_id, r.source_row, r.source_column)
            seen[key] = seen.get(key, 0) + 1
        assert seen == places
        domains = {r.hostname: r.link_count for r in L.domains(L.links(found)).collect()}
        want = {}
        for url in links:
            want[url.split("/")[2]] = want.get(url.split("/")[2], 0) + 1
        assert domains == want == {r.hostname: r.link_count for r in L.domain_counts(found).collect()}
        sources = {}
        for url, source, _, _ in places:
            sources.setdefault(url.split("/")[2], set()).add(source)
        assert {r.hostname: r.source_count for r in L.domain_sources(found).collect()} == {h: len(s) for h, s in sources.items()}
        found.unpersist()


def test_result_does_not_depend_on_partitions(spark):
    rows = random_rows(3)
    results = []
    for parts in (1, 3, 16):
        table = L.with_link_ids(L.links(occurrences(records(spark, rows).repartition(parts))))
        results.append(sorted(map(str, table.collect())))
    assert results[0] == results[1] == results[2]


def test_first_sightings_need_one_shuffle_with_partial_aggregation(spark):
    plan = L.links(occurrences(records(spark, random_rows(1))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_min" in plan
    for bad in ("CartesianProduct", "NestedLoopJoin", "SortMergeJoin", "Window"):
        assert bad not in plan


def test_dense_ids(spark):
    df = spark.range(0, 5000, 1, 11).select(F.expr("id * 7919 % 5003").alias("k"), F.col("id").alias("v"))
    rows = with_dense_ids(df, ["k"], "n", 10).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(10, 5010))
    assert [r.k for r in rows] == sorted(r.k for r in rows)
    assert with_dense_ids(df.where("k < 0"), ["k"], "n").count() == 0


def test_queue_equals_a_replay(spark):
    for seed in (1, 2, 3):
        rnd = random.Random(seed)
        events = []
        for seq in range(1, 400 * 2**16, 2**16):
            kind = rnd.choices(["ADD", "REMOVE", "CLEAR"], [60, 38, 2])[0]
            link = None if kind == "CLEAR" else rnd.choice([1, 1, 1, *range(2, 12)])
            events.append((seq, kind, link, rnd.choice(["LOW", "NORMAL", "HIGH", "odd", None]), None))
        state = {}
        for seq, kind, link, priority, _ in events:
            if kind == "CLEAR":
                state = {}
            elif kind == "REMOVE":
                state.pop(link, None)
            elif link not in state:
                state[link] = (seq, priority if priority in ("LOW", "NORMAL", "HIGH") else "NORMAL")
        df = spark.createDataFrame(events, "seq long, action string, link_id long, priority string, event_time timestamp_ntz")
        queue = Q.current_queue(df)
        assert {r.link_id: (r.queue_id, r.priority) for r in queue.collect()} == state
        links = spark.range(1, 13).selectExpr("id AS link_id", "'u' AS normalized_url", "'h' AS hostname", "'p' AS path")
        rank = {"HIGH": 0, "NORMAL": 1, "LOW": 2}
        order = [link for link, _ in sorted(state.items(), key=lambda s: (rank[s[1][1]], -s[1][0]))]
        assert [r.link_id for r in Q.queue_list(queue, links).collect()] == order
    empty = spark.createDataFrame([], df.schema)
    assert Q.current_queue(empty).count() == 0
    assert Q.clear_event(empty, F.lit(None).cast("timestamp_ntz")).first().seq == 1


def test_new_files(spark):
    files = spark.createDataFrame([("b", "h1", 1), ("a", "h1", 1), ("c", "h2", 1), ("d", "h2", 2), ("e", "h3", 1)], "path string, file_hash string, file_size long")
    known = spark.createDataFrame([("h2", 1, "complete"), ("h3", 1, "in_progress")], "file_hash string, file_size long, status string")
    assert sorted(r.path for r in new_files(files, known, ["path"]).collect()) == ["a", "d", "e"]


def test_reports(spark):
    links = spark.createDataFrame([(f"2024-{m:02d}-01",) for m in range(1, 13)] * 2 + [("2023-05-01",)] * 3, "d string").select(F.col("d").cast("timestamp_ntz").alias("first_seen"))
    grown = R.library_growth(links, 3).collect()
    assert [(r.month, r.n) for r in grown] == [("2023-05", 3), ("2024-01", 2), ("2024-02", 2)]
    assert [r.month for r in R.library_growth(links, 2, newest=True).collect()] == ["2024-12", "2024-11"]
    domains = spark.createDataFrame([("a.com", "a.com", 3), ("b.a.com", "a.com", 2), ("x.gov.uk", "", 4)], "hostname string, registered_domain string, link_count long")
    sources = spark.range(5)
    queue = spark.range(4)
    assert tuple(R.library_totals(domains, sources, queue).first()) == (9, 3, 1, 5, 4)
    assert tuple(R.library_totals(domains.where("false"), sources, queue.limit(0)).first()) == (0, 0, 0, 5, 0)
    assert R.registered_domain_count(domains).first()[0] == R.registered_domain_count(domains, True).first()[0] == 1
    assert [tuple(r) for r in R.tld_breakdown(domains).collect()] == [(".com", 5), (".gov", 4)]


def test_history_of_a_hot_source_is_dealt_over_blocks(spark, monkeypatch):
    """With many sources, a source that holds nearly all places is joined in many tasks."""
    places = spark.range(4000).selectExpr("concat('u', id) AS normalized_url", "if(id < 3900, 1L, id) AS source_id", "id AS source_row", "'c' AS source_column")
    sources = places.selectExpr("source_id", "concat('s', source_id) AS source_file", "timestamp_ntz'2026-01-01' AS imported_at").distinct()
    want = sorted(map(tuple, search.source_history(places, sources).collect()))
    monkeypatch.setattr(search, "BROADCAST_SOURCES", 5)
    found = search.source_history(places, sources)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 4000
    keyed = places.withColumn("block", F.pmod(F.xxhash64("normalized_url", "source_row"), F.lit(search.SOURCE_BLOCKS)))
    assert keyed.groupBy("source_id", "block").count().agg(F.max("count")).first()[0] < 200


def test_first_sightings_tell_what_is_wanted(spark):
    rows = [*random_rows(4), (None, 7, 0, None, "http://Hot.com/ http://h1.com/1"), (1, None, 0, None, "http://h1.com/1 http://h2.com/2")]
    found = occurrences(records(spark, rows).repartition(5)).cache()
    names = L.SIGHTING_COLUMNS
    whole = L.first_sightings(found)
    assert whole.columns == ["normalized_url", *names]
    whole = {r.normalized_url: r for r in whole.collect()}
    assert whole["http://hot.com/"].source_id is None
    for wanted in ((), ("source_id",), ("last_seen", "sightings"), ("original_url",), ("source_row", "source_column"), (*READING_ORDER, "source_file", "first_seen")):
        told = L.first_sightings(found, wanted).collect()
        assert sorted(r.normalized_url for r in told) == sorted(whole)
        assert all(r[c] == whole[r.normalized_url][c] for r in told for c in wanted)
    plan = L.first_sightings(found, ("source_id",))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    numbered = L.with_link_ids(L.first_sightings(found, READING_ORDER), wanted=())
    assert numbered.columns == ["normalized_url", "link_id"]
    assert set(map(tuple, numbered.collect())) == {(r.normalized_url, r.link_id) for r in L.with_link_ids(L.first_sightings(found)).collect()}
    found.unpersist()


def test_few_splits_become_more_tasks_than_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    dealt = spread(spark.range(0, 1000, 1, cores + 1), "id")
    assert dealt.rdd.getNumPartitions() == 8 * (cores + 1) and dealt.distinct().count() == 1000
    assert spread(spark.range(0, 1000, 1, 4 * cores), "id").rdd.getNumPartitions() == 4 * cores


def test_links_are_not_shuffled_for_a_few_places(spark):
    links = spark.range(1, 200).selectExpr("id AS link_id", "concat('u', id) AS normalized_url", "'h' AS hostname", "'s' AS status")
    places = spark.createDataFrame([("u5", 3), ("u9", 3), ("u5", 3), ("u7", 4), ("none", 3), (None, 3)], "normalized_url string, source_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        page = search.source_links(places, links, 3)
        assert [r.link_id for r in page.collect()] == [9, 5, 5]
        assert "SortMergeJoin" not in page._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_export_order_comes_before_the_derived_columns(spark, tmp_path):
    first = L.first_sightings(occurrences(records(spark, random_rows(5))))
    export.export_all(L.described(first), str(tmp_path / "a"))
    export.export_all(L.described(export.in_export_order(first)), str(tmp_path / "b"), ordered=True)
    a, b = ([line for p in sorted((tmp_path / f).glob("part-*")) for line in p.read_text().splitlines()[1:]] for f in "ab")
    assert a == b and len(a) > 20


def test_wanted_links_that_exist_are_queued_once(spark):
    links = spark.createDataFrame([(n,) for n in (1, 2, 2, 3, 4)], "link_id long")
    wanted = spark.createDataFrame([(n,) for n in (2, 2, 4, 9, None)], "link_id long")
    queue = spark.createDataFrame([(4,)], "link_id long")
    events = Q.add_events(queue, links, wanted, F.lit("HIGH"), F.lit(None).cast("timestamp_ntz"), F.col("link_id") + 10)
    assert [(r.seq, r.link_id, r.priority) for r in events.collect()] == [(12, 2, "HIGH")]


def test_export_written_takes_less_disk_than_its_rows(spark, tmp_path):
    """The export's parts are compressed CSV that reads as the rows that were exported, in its order."""
    when = "TIMESTAMP'2024-03-01 00:00:00'"
    spark.range(400).selectExpr(
        "id AS l_orderkey", "id * 3 AS l_partkey", "id % 50 AS l_suppkey", "1 AS l_linenumber",
        "CASE id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS l_returnflag", f"{when} AS l_shipdate",
    ).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(40).selectExpr("id AS page_id", "concat('https://example.com/a,b\"', id, '/x') AS url", "'' AS html").write.parquet(
        str(tmp_path / "pages.parquet")
    )
    spark.createDataFrame([(1, "a http://one.example.org/\"q\"", "en", "src1")], "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    written = catalog.export_written(spark, str(tmp_path))
    parts = written.inputFiles()
    assert all(p.endswith(".csv.gz") for p in parts)
    rows = written.collect()
    assert sorted(map(str, rows)) == sorted(map(str, catalog.export_all(spark, str(tmp_path)).na.fill("").collect()))
    plain = sum(len(",".join(v or "" for v in r)) for r in rows)
    assert sum(Path(p.removeprefix("file:")).stat().st_size for p in parts) < plain / 3
    assert sum((r.original_url or "").startswith("HTTPS://Shop") for r in rows) > 100
