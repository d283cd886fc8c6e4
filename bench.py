"""Times headline queries over the test tables, and an import of generated lines.

Prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_LINES the number
of generated lines (one million, the size of the reference workload).
"""

import json
import os
import time

from linkloom.operators import links as L
from linkloom.operators import reports as R
from linkloom.operators.occurrences import occurrences
from linkloom.plans.catalog import QUERIES
from linkloom.session import build_session, stage

HEADLINES = (
    "extract_urls",
    "normalize_urls",
    "links",
    "domains",
    "source_counters",
    "link_sources",
    "domain_source_counts",
    "url_source_history",
    "import_report",
    "top_domains",
    "tld_breakdown",
    "library_growth",
    "library_totals",
    "search_links",
    "search_simple",
    "links_page",
    "queue_list",
    "new_links_only",
    "page_links",
    "unwrap_redirects",
    "scan_txt",
    "scan_csv_cells",
    "export_by_domain",
)
# The hosts of the generated workload.
HOSTS = (
    "example.gov",
    "data.gov",
    "state.la.us",
    "nasa.gov",
    "epa.gov",
    "example.com",
    "example.org",
    "foo.example.co.uk",
)


def generated_lines(spark, n: int):
    """n distinct links over eight hosts, one a line."""
    from pyspark.sql import functions as F

    i = F.col("id")
    host = F.element_at(F.array(*[F.lit(h) for h in HOSTS]), (i % len(HOSTS) + 1).cast("int"))
    text = F.concat(
        F.lit("https://"), host, F.lit("/item/"), i.cast("string"), F.lit("?q="), (i % 97).cast("string")
    )
    return spark.range(n).select(
        F.lit(1).cast("long").alias("source_id"),
        F.lit("bench_urls.txt").alias("source_file"),
        (i + 1).alias("source_row"),
        F.lit(0).alias("col_idx"),
        F.lit(None).cast("string").alias("source_column"),
        F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("seen_at"),
        text.alias("text"),
    )


def run_import(spark, n: int) -> dict:
    """Occurrences, links and domains of the generated lines, all written; with their totals."""
    found = stage(occurrences(generated_lines(spark, n)))
    links = stage(L.described(L.with_link_ids(L.first_sightings(found))))
    hosts = stage(L.domains(links))
    totals = hosts.agg({"link_count": "sum"}).first()[0]
    buckets = {r.bucket: r.n for r in R.tld_breakdown(hosts).collect()}
    return {"discovered": found.count(), "unique": totals, "hosts": hosts.count(), "buckets": buckets}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    lines = int(os.environ.get("BENCH_LINES", "1000000"))
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["top_domains"](spark, sf_dir).collect()  # start the JVM and the Python workers
    seconds = {}
    for name in HEADLINES:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    begin = time.perf_counter()
    totals = run_import(spark, lines)
    seconds["import_generated_lines"] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "import": {
                    "lines": lines,
                    "urls_per_second": round(lines / seconds["import_generated_lines"]),
                    **totals,
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
