import re

import pytest
from pyspark.sql import functions as F

from linkloom.functions.text import before, has_extension, safe_directory, since, sql_like
from linkloom.operators.search import LinkFilter, fetch_page, marked_page, newest_links, search


def like_model(text, pattern):
    """LIKE of a database that ignores ASCII case."""
    rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.fullmatch(rx, text, re.S | re.I | re.A) is not None


TEXTS = ["abc", "ABC", "a\\c", "a%c", "a_c", "aXXc", "ÄBC", "äbc", "a.c", "", "x\ny", "[a]", "\\E", "K"]


@pytest.mark.parametrize("pattern", ["abc", "%B%", "a_c", "a%c", "%", "", "_", "%\\%", "%.%", "ä%", "x%y", "%[a]", "\\E", "k", "%a__c%", "__"])
def test_like(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: r.m for r in df.withColumn("m", sql_like(F.col("t"), pattern)).collect()}
    assert got == {t: like_model(t, pattern) for t in TEXTS}


@pytest.mark.parametrize("limit", ["2026", "2026-01", "2026-01-31", "2026-01-31T10", "2026-01-31T10:00:00Z", "2026-01-31T10:00:01Z"])
def test_dates_compare_as_text(spark, limit):
    times = ["2025-12-31T23:59:59Z", "2026-01-01T00:00:00Z", "2026-01-30T23:59:59Z", "2026-01-31T00:00:00Z", "2026-01-31T10:00:00Z", "2026-02-01T00:00:00Z"]
    df = spark.createDataFrame([(t,) for t in times], "t string").withColumn("m", F.expr("CAST(replace(replace(t, 'T', ' '), 'Z', '') AS TIMESTAMP_NTZ)"))
    for r in df.select("t", before(F.col("m"), limit).alias("b"), since(F.col("m"), limit).alias("s")).collect():
        assert (r.b, r.s) == (r.t <= limit, r.t >= limit), r.t


def test_small_predicates(spark):
    df = spark.createDataFrame([("/A/B.PDF", "..ex ample/ü.com"), ("/pdf", "..."), (None, "")], "p string, n string")
    rows = df.select(has_extension(F.col("p"), "pdf").alias("e"), safe_directory(F.col("n")).alias("d")).collect()
    assert [r.e for r in rows] == [True, False, None]
    assert [r.d for r in rows] == ["ex_ample_ü.com", "unknown", "unknown"]


@pytest.fixture(scope="module")
def links(spark):
    i = F.col("id")
    return spark.range(1, 26).select(
        i.alias("link_id"),
        F.concat(F.lit("https://example.gov/item/"), i.cast("string")).alias("normalized_url"),
        F.lit("o").alias("original_url"),
        F.lit("https").alias("scheme"),
        F.lit("example.gov").alias("hostname"),
        F.lit("example.gov").alias("registered_domain"),
        F.concat(F.lit("/item/"), i.cast("string")).alias("path"),
        F.lit("").alias("query"),
        F.when(i < 13, "a.txt").otherwise("b.txt").alias("source_file"),
        F.lit("2026-01-01").cast("timestamp_ntz").alias("first_seen"),
        F.when(i == 3, "QUEUED").alias("status"),
    )


def test_keyset_pages(links):
    one = fetch_page(links, limit=10, include_total=True)
    assert [r["link_id"] for r in one["items"]] == list(range(25, 15, -1))
    assert one["has_more"] and one["next"] == 16 and one["total"] == 25
    two = fetch_page(links, limit=10, after=one["next"])
    assert [r["link_id"] for r in two["items"]] == list(range(15, 5, -1)) and two["total"] is None
    three = fetch_page(links, limit=10, after=two["next"])
    assert len(three["items"]) == 5 and not three["has_more"] and three["next"] is None
    assert [r["link_id"] for r in fetch_page(links, limit=2, offset=3)["items"]] == [22, 21]
    assert len(fetch_page(links, limit=0)["items"]) == 1 and fetch_page(links, limit=999)["limit"] == 200
    marked = marked_page(newest_links(links, 10, after=6), 10).collect()
    assert len(marked) == 5 and not marked[0].has_more and marked[0].next_id is None


def test_filters_combine(links):
    assert search(links, LinkFilter()).count() == 25
    assert search(links, LinkFilter(q="ITEM/2", scheme="HTTPS", source="a.txt")).count() == 1
    assert search(links, LinkFilter(status="QUEUED")).count() == 1
    assert search(links, LinkFilter(status="DISCOVERED", path_contains="tem/1", domain="example.gov")).count() == 11
    assert search(links, LinkFilter(registered_domain="x")).count() == 0


def test_exact_filters_reach_the_files(spark, links, tmp_path):
    links.write.parquet(str(tmp_path / "l"))
    found = search(spark.read.parquet(str(tmp_path / "l")), LinkFilter(domain="example.gov", scheme="HTTPS")).select("link_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hostname,example.gov)" in plan and "EqualTo(scheme,https)" in plan
    assert "normalized_url" not in plan
