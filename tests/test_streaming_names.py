from datetime import datetime, timedelta
from unittest.mock import MagicMock

from pyspark.sql import Row
from pyspark.sql import functions as F

from worldpulse.operators import identity
from worldpulse.streaming import names

FAR = datetime(2031, 1, 1)


def test_forgotten_at():
    assert names.forgotten_at(datetime(2024, 1, 15, 7)) == datetime(2024, 7, 15, 7)
    assert names.forgotten_at(datetime(2024, 8, 31, 12)) == datetime(2025, 3, 1)
    assert names.forgotten_at(datetime(2023, 8, 29)) == datetime(2024, 2, 29)
    assert names.forgotten_at(datetime(2023, 10, 31)) == datetime(2024, 5, 1)


def test_observations_of_a_key_go_to_its_state_in_one_message():
    handle, processor = MagicMock(), names.Names()
    processor.init(handle)
    handle.reset_mock()
    list(processor.handleInputRows((1,), iter([Row(micros=5_000 * k + 1, id=k, name="a") for k in range(100, 0, -1)]), None))
    # One for all rows, and a timer for the earliest.
    assert len(handle.mock_calls) == 2
    handle.registerTimer.assert_called_once_with(6)


def run(spark, path, tmp_path, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = names.changes(stream, "key", "name", "seen_at", "id", late_by="3 days")
    names.run_to(found, str(tmp_path / "out"), str(tmp_path / "c"))


def test_the_history_is_that_of_the_batch_over_a_restart(spark, tmp_path):
    t = datetime(2024, 1, 1)
    # In each file times are up to two days out of order; files follow each other.
    rows = [(k % 7, "ab"[(k * k // 5 + k % 3) % 2] + str(k // 60), t + timedelta(hours=2 * k, days=(k * 5) % 3 - 1, microseconds=k), k) for k in range(240)]
    schema = "key long, name string, seen_at timestamp, id long"
    path = str(tmp_path / "in")
    for part in (0, 80, 160):
        spark.createDataFrame(rows[part : part + 80], schema).coalesce(1).write.mode("append").parquet(path)
        if part != 80:
            run(spark, path, tmp_path, schema)
    spark.createDataFrame([(100, "end", FAR, 1000), (100, "over", FAR + timedelta(days=30), 1001)], schema).coalesce(1).write.mode("append").parquet(path)
    run(spark, path, tmp_path, schema)
    events = spark.read.parquet(str(tmp_path / "out"))
    found = names.history(events).filter("key < 100").select("key", "name", "valid_from", "valid_to", "active")
    expected = identity.history(spark.createDataFrame(rows, schema), "key", "name", "seen_at", "id")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, expected.collect())))
    # By the end every name that was given up for good has been forgotten, six months later.
    last = expected.filter("valid_to is not null").groupBy("key", "name").agg(F.max("valid_to").alias("given_up"))
    still = expected.filter("active").select("key", "name")
    due = {(r["key"], r["name"], r["given_up"]) for r in last.join(still, ["key", "name"], "left_anti").collect()}
    gone = {(r["key"], r["name"], r["valid_from"]) for r in events.filter("event = 'forgotten' and key < 100").collect()}
    assert due and gone == due
    assert all(r["valid_to"] >= names.forgotten_at(r["valid_from"]) for r in events.filter("event = 'forgotten'").collect())
