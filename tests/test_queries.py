"""Every registered query against its SQL counterpart on the smallest tables."""

import importlib.util
import pathlib

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
ENTRY = pathlib.Path(__file__).resolve().parent.parent / "__spark_entry__.py"
spec = importlib.util.spec_from_file_location("spark_entry", ENTRY)
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
ORACLES = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in pathlib.Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def shown(rows):
    return sorted(tuple("" if v is None else "=" + str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, database, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    cursor = database.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})")
    assert shown(rows) == shown(cursor.fetchall())


def test_every_query_has_a_counterpart():
    from linkloom.plans.catalog import QUERIES

    assert set(ORACLES) <= set(entry.queries())
    assert set(QUERIES) <= set(ORACLES)


def test_generated_workload(spark):
    import bench

    totals = bench.run_import(spark, 80_000)
    assert totals == {"discovered": 80_000, "unique": 80_000, "hosts": 8, "buckets": {".gov": 40_000, ".com": 10_000, ".org": 10_000, "other": 20_000}}
