from datetime import datetime

import pytest
from pyspark.sql import functions as F

from worldpulse.operators import snapshots

T = datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def tables(spark):
    worlds = spark.createDataFrame([(1, "Alpha"), (2, "Beta"), (3, "Gamma")], "id long, name string")
    scrapes = spark.createDataFrame([(1, 1, T, 10), (2, 1, T, 20), (3, 2, datetime(2024, 1, 1, 13), 5), (4, 2, datetime(2024, 1, 1, 11), 7)], "id long, world_id long, scrape_time timestamp, players_online int")
    return worlds, scrapes


def test_equal_times_go_to_the_higher_id(tables):
    found = {r["world_id"]: r["players_online"] for r in snapshots.latest(tables[1]).collect()}
    assert found == {1: 20, 2: 5}


def test_worlds_without_snapshot_are_listed_with_0_and_skipped_in_the_total(tables):
    assert {r["world"]: r["players_online"] for r in snapshots.worlds_online(*tables).collect()} == {"Alpha": 20, "Beta": 5, "Gamma": 0}
    assert snapshots.online_total(*tables).first()["total"] == 25
    assert [r["name"] for r in snapshots.worlds_without_snapshot(*tables).collect()] == ["Gamma"]


def test_no_worlds_give_0(tables):
    assert snapshots.online_total(tables[0].limit(0), tables[1].limit(0)).first()["total"] == 0


def test_both_ends_of_a_range_count(tables):
    at = lambda h: F.lit(datetime(2024, 1, 1, h))
    assert [r["players_online"] for r in snapshots.world_history(*tables, "Beta", at(11), at(13)).collect()] == [7, 5]
    assert snapshots.world_history(*tables, "Beta", at(13), at(11)).count() == 0
    assert snapshots.world_history(*tables, "Nowhere", at(11), at(13)).count() == 0


def test_names_are_case_sensitive(tables):
    assert snapshots.world_now(*tables, "alpha").count() == 0


def test_first_known_value_stays(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, "a", 2), (1, "b", 3), (2, None, 1)], "k long, v string, t long")
    assert [tuple(r) for r in snapshots.first_known(rows, "k", "v", "t").collect()] == [(1, "a")]
