import os
import subprocess
import sys
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from worldpulse import catalogue
from worldpulse.operators import cascade
from worldpulse.schemas import REFERENCES
from worldpulse.sources import jdbc

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture()
def url(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def test_ranges_and_filters_come_from_and_go_to_the_database(spark, url):
    rows = spark.range(-50, 950).select("id", F.concat(F.lit("n"), "id").alias("name"))
    jdbc.write(rows, url, "worlds", **DRIVER)
    assert jdbc.bounds(spark, url, "worlds", **DRIVER) == (-50, 949, 1000)
    read = jdbc.read(spark, url, "worlds", range_rows=300, **DRIVER)
    assert read.rdd.getNumPartitions() == 4 and sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))
    per_range = read.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_range) <= 260
    found = read.filter("name = 'n7' and id < 100").select("id")
    assert "*EqualTo(name,n7)" in jdbc.pushed(found) and "*LessThan(id,100)" in jdbc.pushed(found)
    assert [r["id"] for r in found.collect()] == [7] and "name" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_merge_by_key(spark, url):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id long, name string, n int")
    jdbc.write(rows, url, "t", **DRIVER)
    more = spark.createDataFrame([(2, "B", 5), (3, "c", 6)], "id long, name string, n int")
    for _ in range(2):
        jdbc.upsert(more, url, "t", "id", **DRIVER)
        assert sorted(map(tuple, jdbc.read(spark, url, "t", **DRIVER).collect())) == [(1, "a", 1), (2, "B", 5), (3, "c", 6)]
    jdbc.write(rows.limit(0), url, "empty", **DRIVER)
    jdbc.upsert(more, url, "empty", "id", **DRIVER)
    assert jdbc.read(spark, url, "empty", **DRIVER).count() == 2


CLUSTER = """
import sys
from pyspark.sql import SparkSession
from worldpulse import catalogue
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", f"file://{sys.argv[2]}").getOrCreate()
catalogue.queries()["jdbc_round_trip"](spark, sys.argv[1]).write.parquet(f"{sys.argv[2]}/out")
"""


def test_round_trip_on_executors_of_their_own(sf, tmp_path):
    done = subprocess.run([sys.executable, "-c", CLUSTER, sf, str(tmp_path)], capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": ROOT}, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    c = duckdb.connect()
    for t in ("customer", "nation"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    expected = c.execute(catalogue.oracle_sql()["jdbc_round_trip"]).fetchall()
    found = c.execute(f"select id, username, roles, in_ranges, filtered_there from read_parquet('{tmp_path}/out/*.parquet')").fetchall()
    assert sorted(found) == sorted(expected)


def test_texts_come_through_files_as_they_are(spark, tmp_path):
    texts = [None, "", " a ", 'q"uo"te', "com,ma", "li\nne", "it's", "\\", "ä€"]
    rows = spark.createDataFrame([(k, t, None if k % 2 else k) for k, t in enumerate(texts)], "id long, t string, n int")
    database = jdbc.Embedded(spark, str(tmp_path / "db"))
    database.write(rows, database.url, "texts", "id")
    found = jdbc.read(spark, database.publish(), "texts", driver=database.DRIVER)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError, match="local path"):
        jdbc.Embedded(spark, "hdfs://there/db")


def test_a_table_comes_after_what_it_refers_to():
    order = cascade.order()
    assert all(order.index(child) > order.index(target) for (child, _), target in REFERENCES.items())


@pytest.fixture()
def tables(spark):
    return {
        "worlds": spark.createDataFrame([(1,), (2,)], "id long"),
        "scrapes": spark.createDataFrame([(10, 1), (20, 2), (21, None)], "id long, world_id long"),
        "scrape_players": spark.createDataFrame([(100, 10, 5), (200, 20, 5), (201, 20, 6)], "id long, scrape_id long, character_id long"),
        "characters": spark.createDataFrame([(5, 3), (6, None)], "id long, vocation_id long"),
        "vocations": spark.createDataFrame([(3,)], "id long"),
        "users": spark.createDataFrame([(7,)], "id long"),
    }


def ids(rows):
    return sorted(r["id"] for r in rows.collect())


def test_rows_go_over_all_levels(spark, tables):
    gone = spark.createDataFrame([(1,), (1,), (None,), (99,)], "id long")
    left = cascade.delete(tables, {"worlds": gone, "vocations": tables["vocations"]})
    assert {n: ids(rows) for n, rows in left.items()} == {"worlds": [2], "scrapes": [20, 21], "scrape_players": [200, 201], "characters": [5, 6], "vocations": [], "users": [7]}
    assert [r["vocation_id"] for r in left["characters"].collect()] == [None, None]
    assert left["users"] is tables["users"]
    two = cascade.delete(tables, {"characters": spark.createDataFrame([(6,)], "id long"), "scrapes": spark.createDataFrame([(10,)], "id long")})
    assert (ids(two["scrape_players"]), ids(two["scrapes"]), ids(two["characters"])) == ([200], [20, 21], [5])


def test_what_a_database_would_refuse(tables, spark):
    found = {(r["table"], r["column"]): r["n"] for r in cascade.refused(tables, {"scrapes": spark.createDataFrame([(10,)], "id long"), "worlds": tables["worlds"].filter("id = 1")}).collect()}
    # The snapshot of the world goes with this call, and its players with the snapshot.
    assert found == {("scrapes", "world_id"): 0}
    assert {r["n"] for r in cascade.refused(tables, {"worlds": tables["worlds"]}).collect()} == {2}
