from datetime import datetime

import pytest
from pyspark.sql import functions as F

from worldpulse.functions.columns import horizon
from worldpulse.operators import identity
from worldpulse.plans.ids import allocate

CUT = datetime(2024, 2, 29)
NAMES = "id long, character_id long, name string, active boolean, inactive_date timestamp"


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(
        [
            (1, 10, "Now", True, None),
            (2, 10, "Edge", False, CUT),
            (3, 10, "Late", False, datetime(2024, 3, 1)),
            (4, 11, "Unknown", None, datetime(2024, 3, 1)),
            (5, 11, "Undated", False, None),
            (6, 12, "Twice", False, datetime(2024, 4, 1)),
            (7, 13, "Twice", True, None),
            (8, None, "Orphan", True, None),
        ],
        NAMES,
    )


def ids(names):
    return names.select(F.col("character_id").alias("id")).distinct()


def test_recent_names(names):
    found = {r["requested_name"]: r["id"] for r in identity.by_any_name(names, ids(names), F.lit(CUT)).collect()}
    assert found == {"Now": 10, "Late": 10, "Twice": 13}


def test_horizon_is_clamped_to_the_month(spark):
    assert spark.range(1).select(horizon(F.lit(datetime(2024, 8, 31))).alias("t")).first()["t"] == CUT


def seen(spark, *rows):
    return spark.createDataFrame([(n, f, datetime(2024, 5, 1)) for n, f in rows], "name string, former_names string, seen_at timestamp")


def test_resolution(spark, names):
    asked = seen(spark, ("Now", "Now"), ("Fresh", "Fresh"), ("Renamed", "Nobody, Now"), ("Edge", "Edge"))
    found = {r["name"]: (r["character_id"], r["is_new"]) for r in identity.resolve(asked, names, F.lit(CUT)).collect()}
    assert found["Now"] == (10, False) and found["Renamed"] == (10, False)
    assert found["Fresh"][1] and found["Edge"][1]
    assert found["Fresh"][0] is None and found["Edge"][0] is None


def test_new_ids_follow_the_last_one_without_gaps(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).select(F.concat(F.lit("n"), "id").alias("name"), F.lit(None).cast("long").alias("character_id"))
    numbered, last = allocate(rows, "character_id", 40, str(tmp_path))
    assert last == 5040 and numbered.columns == ["name", "character_id"]
    assert sorted(r["character_id"] for r in numbered.collect()) == list(range(41, 5041))
    assert allocate(rows.limit(0), "character_id", 40, str(tmp_path))[1] == 40
    assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()


def test_rename_closes_the_active_version_and_is_idempotent(spark, names):
    resolved = identity.resolve(seen(spark, ("Renamed", "Now")), names, F.lit(CUT))
    once = identity.apply_names(names, resolved)
    state = {(r["character_id"], r["name"]): (r["active"], r["inactive_date"]) for r in once.collect()}
    assert state[10, "Now"] == (False, datetime(2024, 5, 1)) and state[10, "Renamed"] == (True, None)
    assert state[11, "Unknown"][0] is None
    again = identity.apply_names(once, resolved)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, once.collect()))


def test_history_has_one_version_per_change(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 3), (1, None, 4), (1, "a", 5)], "k long, v string, t long")
    found = [tuple(r) for r in identity.history(rows, "k", "v", "t").orderBy("valid_from").collect()]
    assert found == [(1, "a", 1, 3, False), (1, None, 3, 5, False), (1, "a", 5, None, True)]
