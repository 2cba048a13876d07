"""Every registered query of the read model against DuckDB on the same tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from worldpulse import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    expected = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, expected.fetchall())


def as_by_sql(spark, folder, name):
    """The rows of a query over the tables below ``folder`` that are there, after a comparison with those of its SQL."""
    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}/*.parquet')")
    expected = c.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    found = [tuple(r) for r in catalogue.queries()[name](spark, str(folder)).select(*columns).collect()]
    assert rows(columns, found) == rows(columns, expected.fetchall())
    return sorted(found)


def test_titles_that_end_within_a_reference(spark, tmp_path):
    titles = ["a &amp; b &amp", "x &am", "&lt;i&gt", "&amp;lt; &#39", "&#39;&#x27;&quot;", "AT&T &ampx a & b;"]
    pages = [(k, f"<html><head><title>{t}</title></head><body>&amp</body></html>") for k, t in enumerate(titles)]
    spark.createDataFrame([*pages, (9, "<p>none</p>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = dict(as_by_sql(spark, tmp_path, "page_title"))
    assert found[0] == "a & b &amp" and found[2] == "<i&gt" and found[9] is None


def test_two_pages_of_a_world_at_one_time_are_one_snapshot(spark, sf, tmp_path):
    for t in ("nation", "region", "supplier"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    # The world is a key's remainder by 25, the time a date and the key in seconds: orders 25 and 50 meet.
    orders = [(25, "2000-01-01 00:00:25"), (50, "2000-01-01 00:00:00"), (75, "2000-01-01 00:00:00")]
    spark.createDataFrame(orders, "o_orderkey long, at string").select("o_orderkey", F.col("at").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(25, 1), (25, 2), (50, 2), (50, 3), (75, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [r[2] for r in as_by_sql(spark, tmp_path, "pass_players")] == [3, 1]


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_filters_reach_the_scan(spark, sf):
    df = catalogue.queries()["world_history"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan and "GreaterThanOrEqual(ts" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_latest_reduces_before_the_shuffle(spark, sf):
    plan = catalogue.queries()["latest_per_key"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    ranked = catalogue.queries()["latest_by_rank"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in ranked
