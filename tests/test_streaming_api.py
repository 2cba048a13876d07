import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worldpulse.api import Questions, as_json, graph_worlds
from worldpulse.catalog import view
from worldpulse.operators import snapshots
from worldpulse.plans import store
from worldpulse.plans.ingest import with_latest
from worldpulse.plans.tables import Changes, Tables
from worldpulse.sources.tables import vocations
from worldpulse.streaming import live


@pytest.fixture(scope="module")
def landed(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "scrapes")
    view(spark, sf, "scrapes").repartition(3).write.parquet(path)
    return path


def drain(stream, tmp_path, mode):
    name = "s" + str(abs(hash(str(tmp_path))))
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_stream_gives_what_the_batch_gives(spark, sf, landed, tmp_path):
    batch = view(spark, sf, "scrapes")
    stream = live.snapshot_stream(spark, landed, batch.schema, max_files=1)
    found = drain(live.live_latest(stream), tmp_path, "complete")
    rows = lambda df: sorted((r["world_id"], r["players_online"]) for r in df.collect())
    assert rows(found) == rows(snapshots.latest(batch))


def test_windows_close_past_the_watermark(spark, sf, landed, tmp_path):
    batch = view(spark, sf, "scrapes")
    stream = live.snapshot_stream(spark, landed, batch.schema)
    found = drain(live.windowed_counts(stream, "1 day"), tmp_path, "append")
    days = batch.select(F.to_date("scrape_time").alias("d")).distinct().count()
    closed = found.select("window_start").distinct().count()
    assert days - 1 == closed


def test_repeats_and_sessions(spark, sf, landed, tmp_path):
    batch = view(spark, sf, "scrapes")
    stream = live.snapshot_stream(spark, landed, batch.schema)
    found = drain(live.without_repeats(stream), tmp_path, "append")
    assert found.count() <= batch.count() and found.select("world_id", "scrape_time").distinct().count() == found.count()


def test_scores_meet_the_snapshots_near_them(spark, tmp_path):
    t = datetime(2024, 1, 1)
    scrapes = spark.createDataFrame([(k % 3, t + timedelta(minutes=7 * k), k) for k in range(200)], "world_id long, scrape_time timestamp, players_online int").coalesce(4)
    records = spark.createDataFrame([(k % 4, k, "EXPERIENCE", k, t + timedelta(minutes=11 * k + 3)) for k in range(120)], "world_id long, character_id long, category string, value long, scraped_at timestamp").coalesce(4)
    far = t + timedelta(days=30)
    scrapes.orderBy("scrape_time").coalesce(1).write.option("maxRecordsPerFile", 50).parquet(str(tmp_path / "s"))
    records.orderBy("scraped_at").coalesce(1).write.option("maxRecordsPerFile", 30).parquet(str(tmp_path / "r"))
    streams = [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for df, n in ((scrapes, "s"), (records, "r"))]
    q = live.scores_near(*streams).writeStream.format("memory").queryName("near").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    # One late row on each side moves the watermark past all others, whose state goes.
    spark.createDataFrame([(9, far, 1)], scrapes.schema).write.mode("append").parquet(str(tmp_path / "s"))
    spark.createDataFrame([(8, 1, "EXPERIENCE", 1, far)], records.schema).write.mode("append").parquet(str(tmp_path / "r"))
    q.processAllAvailable()
    left = sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
    q.stop()
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert rows(spark.table("near")) == rows(live.scores_near(scrapes, records)) != []
    assert left == 2


def test_batches_are_written_once(spark, sf, landed, tmp_path):
    batch = view(spark, sf, "scrapes")
    q = live.run(live.snapshot_stream(spark, landed, batch.schema, max_files=1), live.append_sink(str(tmp_path), "t"), str(tmp_path / "c"), once=True)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == batch.count()


def test_replace_swaps_a_table(spark, tmp_path):
    folder = str(tmp_path)
    store.replace(spark.range(5), folder, "t")
    before = store.read(spark, folder, "t")
    store.replace(before.filter("id > 2"), folder, "t", "id")
    # A reader that has begun still finds the version it began with.
    assert before.count() == 5 and sorted(r["id"] for r in store.read(spark, folder, "t").collect()) == [3, 4]
    assert store.vacuum(spark, folder, "t") == 1 and store.read(spark, folder, "t").count() == 2
    assert store.exists(spark, folder, "t") and not store.exists(spark, folder, "u")
    with pytest.raises(FileNotFoundError):
        store.read(spark, folder, "u")
    store.append(spark.range(1), folder, "grows")
    store.append(spark.range(2), folder, "grows")
    assert spark.read.parquet(f"{folder}/grows").count() == 3


def test_a_failed_replacement_leaves_the_table(spark, tmp_path):
    folder = str(tmp_path)
    store.replace(spark.range(3), folder, "t")
    bad = spark.range(3).selectExpr("id", "raise_error('no') as x")
    with pytest.raises(Exception, match="no"):
        store.replace(bad, folder, "t")
    assert store.read(spark, folder, "t").count() == 3


@pytest.fixture(scope="module")
def questions(spark):
    t = datetime(2024, 1, 1, 12)
    return Questions(
        worlds=spark.createDataFrame([(1, "Alpha"), (2, "Empty")], "id long, name string"),
        scrapes=spark.createDataFrame([(1, 1, t, 123)], "id long, world_id long, scrape_time timestamp, players_online int"),
        characters=spark.createDataFrame([(7, 1, None)], "id long, vocation_id long, level int"),
        names=spark.createDataFrame([(1, 7, "Now", True, None), (2, 7, "Was", False, datetime(2023, 12, 1))], "id long, character_id long, name string, active boolean, inactive_date timestamp"),
        records=spark.createDataFrame([(1, 7, "EXPERIENCE", t.date(), 2**40, 3, 1)], "id long, character_id long, category string, date date, value long, rank int, world_id long"),
        vocations=vocations(spark),
    )


def test_six_questions(questions):
    as_of = datetime(2024, 1, 2)
    assert questions.total().first()["total"] == 123
    assert {r["world"]: r["playersOnline"] for r in questions.online_by_world().collect()} == {"Alpha": 123, "Empty": 0}
    assert questions.online_in("Empty").first()["playersOnline"] == 0
    assert [tuple(r) for r in questions.history("Alpha", as_of=as_of).collect()] == [("2024-01-01T12:00:00Z", 123)]
    r = questions.character("Was", as_of=as_of).first()
    assert (r["name"], r["level"], r["vocationId"], r["vocation"]) == ("Was", None, 1, "druid")
    assert [tuple(r) for r in questions.stat_history("Now", "EXPERIENCE", as_of=as_of).collect()] == [("2024-01-01", 2**40, 3, "Alpha")]


def test_stored_tables_give_the_same_answers(spark, questions, tmp_path):
    details = ("sex", "achievement_points", "residence", "last_login", "acc_status", "creation_date")
    none = [F.lit(None).alias(c) for c in details]
    facts = [F.lit(None).alias(c) for c in ("pvp_type", "location", "online_record", "creation_date", "transfer_type", "game_world_type")]
    q = questions
    changes = Changes(
        replaced={"worlds": q.worlds.select("*", *facts), "character_names": q.names},
        appended={"scrapes": q.scrapes, "characters": q.characters.select("*", *none), "character_statrecords": q.records.select("*", F.col("date").cast("timestamp").alias("scraped_at"), F.lit(1).alias("vocation_id"))},
    )
    stored = Questions.over(Tables(spark, str(tmp_path / "t")).commit("all", with_latest(Tables(spark, str(tmp_path / "t")), changes)))
    as_of = datetime(2024, 1, 2)
    for ask in (lambda x: x.total(), lambda x: x.online_by_world(), lambda x: x.online_in("Alpha"), lambda x: x.history("Alpha", as_of=as_of), lambda x: x.character("Was", as_of=as_of), lambda x: x.stat_history("Was", "EXPERIENCE", as_of=as_of)):
        assert sorted(map(repr, ask(stored).collect())) == sorted(map(repr, ask(q).collect()))
    now = stored.total().inputFiles()
    assert not any("/scrapes/" in f for f in now) and any("/scrapes_latest/" in f for f in now)
    # A question finds its key first; the answer itself doesn't search the names again.
    assert not any("/character_names/" in f for f in stored.stat_history("Was", "EXPERIENCE", as_of=as_of).inputFiles())


def test_unknown_names_raise(questions):
    for ask in (lambda: questions.online_in("x"), lambda: questions.history("x"), lambda: questions.character("Was", as_of=datetime(2030, 1, 1)), lambda: questions.stat_history("x", "EXPERIENCE")):
        with pytest.raises(LookupError):
            ask()
    with pytest.raises(ValueError):
        questions.stat_history("Now", "NONE")


def test_json_keeps_nulls(questions):
    row = json.loads(as_json(questions.character("Now", as_of=datetime(2024, 1, 2))).first()["json"])
    assert row["level"] is None and row["status"] is None
    assert graph_worlds(questions.online_by_world()).columns == ["name", "playersOnline"]
