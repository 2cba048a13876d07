from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worldpulse import schemas
from worldpulse.operators import snapshots
from worldpulse.plans import commits, ingest
from worldpulse.plans.tables import Changes, Tables, run

T0 = datetime(2024, 5, 1)
NAMES = ("worlds", "character_names", "scrapes", "characters", "scrape_players", "scrapes_latest")


def landed(spark, day, *players):
    """One page of the world Alpha, ``day`` days after the first."""
    facts = "pvp_type string, online_record string, creation_date date, transfer_type string, game_world_type string"
    pages = spark.createDataFrame([("Alpha", T0 + timedelta(days=day), len(players), None, None, None, None, None, list(players))], f"name string, fetched_at timestamp, players_online int, {facts}, players array<string>")
    overview = spark.createDataFrame([("Alpha", "Open", "EU")], "name string, pvp_type string, location string")
    return overview, pages, spark.createDataFrame([], "name string, former_names string"), F.lit(T0 + timedelta(days=day))


def state(spark, folder):
    tables = Tables(spark, folder)
    return {name: sorted(map(repr, tables.read(name).collect())) for name in NAMES}


def test_a_pass_is_all_or_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    ingest.run_world_pass(spark, folder, "one", *landed(spark, 0, "Ay", "Bee"))
    before = state(spark, folder)
    assert [len(before[n]) for n in NAMES] == [1, 2, 1, 2, 2, 1]
    write, rename = Tables._write, commits.rename_text
    for dies_at in range(6):  # five tables change, then comes the log
        written = []

        def dying(self, name, rows):
            if len(written) == dies_at:
                raise RuntimeError("killed")
            written.append(name)
            return write(self, name, rows)

        def no_rename(*args, **more):
            raise RuntimeError("killed")

        monkeypatch.setattr(Tables, "_write", dying)
        monkeypatch.setattr(commits, "rename_text", no_rename if dies_at == 5 else rename)
        with pytest.raises(RuntimeError, match="killed"):
            ingest.run_world_pass(spark, folder, "two", *landed(spark, 1, "Ay", "Cee"))
        assert state(spark, folder) == before
    monkeypatch.setattr(Tables, "_write", write)
    monkeypatch.setattr(commits, "rename_text", rename)
    ingest.run_world_pass(spark, folder, "two", *landed(spark, 1, "Ay", "Cee"))
    after = state(spark, folder)
    assert [len(after[n]) for n in NAMES] == [1, 3, 2, 3, 4, 1]
    ingest.run_world_pass(spark, folder, "two", *landed(spark, 1, "Ay", "Dee"))
    assert state(spark, folder) == after
    assert Tables(spark, folder).vacuum() > 0 and state(spark, folder) == after


def files_of(tables, name):
    return {f.rsplit("/part=", 1)[1] for f in tables.read(name).inputFiles()}


def test_a_merge_leaves_other_files_alone(spark, tmp_path, monkeypatch):
    none = F.lit(None).cast("timestamp")
    rows = spark.range(0, 4000, 1, 8).select("id", (F.col("id") * 10).alias("character_id"), F.concat(F.lit("n"), "id").alias("name"), F.lit(True).alias("active"), none.alias("inactive_date"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables = Tables(spark, str(tmp_path / "t")).commit("start", Changes(replaced={"character_names": rows}))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = files_of(tables, "character_names")
    assert len(before) == 4
    changed = rows.filter("id in (7, 9)").withColumn("name", F.lit("other")).unionByName(rows.filter("id < 2").withColumn("id", F.col("id") + 9000))
    for step, few in (("few", 1000), ("many", 1)):
        monkeypatch.setattr("worldpulse.plans.tables.FEW_IDS", few)
        after = tables.commit(step, Changes(merged={"character_names": changed}))
        now = files_of(after, "character_names")
        assert len(before & now) == 3 and len(now - before) <= 4
        expected = rows.join(changed, "id", "left_anti").unionByName(changed)
        assert sorted(map(repr, after.read("character_names").collect())) == sorted(map(repr, expected.collect()))
        # The tables as they were before are still there to read.
        assert tables.read("character_names").count() == (4000 if step == "few" else 4002)
        tables = Tables(spark, str(tmp_path / "t"))
        before = now
    assert tables.vacuum() > 0 and tables.read("character_names").count() == 4002
    nothing = tables.commit("nothing", Changes(merged={"character_names": changed.limit(0)}))
    assert files_of(nothing, "character_names") == files_of(tables, "character_names")
    one = nothing.compacted("character_names")
    assert one.read("character_names").count() == 4002 and not one.gone["character_names"]


def test_of_two_passes_at_once_one_is_refused(spark, tmp_path):
    folder = str(tmp_path / "t")
    one, two = Tables(spark, folder), Tables(spark, folder)
    rows = spark.createDataFrame([(1, "Alpha")], "id long, name string")
    whole = lambda n: rows.select("id", F.lit(n).alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("pvp_type", "location", "online_record", "creation_date", "transfer_type", "game_world_type")])
    one.commit("a", Changes(replaced={"worlds": whole("first")}))
    with pytest.raises(commits.Conflict):
        two.commit("b", Changes(replaced={"worlds": whole("second")}))
    assert [r["name"] for r in Tables(spark, folder).read("worlds").collect()] == ["first"]
    # A planned pass is planned again on what the other one left.
    seen = []

    def plan(tables):
        seen.append(tables.at)
        if len(seen) == 1:
            Tables(spark, folder).commit("between", Changes(replaced={"worlds": whole("between")}))
        return Changes(replaced={"worlds": tables.read("worlds").withColumn("location", F.lit("x"))})

    run(spark, folder, "c", plan)
    assert seen == [1, 2] and [(r["name"], r["location"]) for r in Tables(spark, folder).read("worlds").collect()] == [("between", "x")]


def test_a_name_that_comes_back_is_another_character(spark, tmp_path):
    folder = str(tmp_path / "t")
    ingest.run_world_pass(spark, folder, "one", *landed(spark, 0, "X"))
    overview, pages, _, as_of = landed(spark, 10, "Y")
    ingest.run_world_pass(spark, folder, "two", overview, pages, spark.createDataFrame([("Y", "X")], "name string, former_names string"), as_of)
    # Within the horizon X still finds the one that is called Y now; a highscore list knows active names alone.
    lists = spark.createDataFrame([("Alpha", "EXPERIENCE", 1, 1, 1, "X", 5), ("Alpha", "EXPERIENCE", 1, 1, 2, "Y", 4)], "world string, category string, vocation_id int, page int, rank int, name string, value long")
    by_list = ingest.run_highscores(spark, folder, "scores", lists, F.lit(T0 + timedelta(days=11)))
    assert by_list.read("character_statrecords").select("character_id").distinct().count() == 2
    tables = ingest.run_world_pass(spark, str(tmp_path / "u"), "one", *landed(spark, 0, "X"))
    ingest.run_world_pass(spark, tables.folder, "two", overview, pages, spark.createDataFrame([("Y", "X")], "name string, former_names string"), as_of)
    tables = ingest.run_world_pass(spark, tables.folder, "three", *landed(spark, 400, "X", "Y"))
    for t in (tables, by_list):
        held = {(r["name"], r["active"]): r["character_id"] for r in t.read("character_names").collect()}
        assert held["Y", True] == held["X", False] == 1 and held["X", True] == 2
        broken = schemas.violations("character_names", t.read("character_names"), {"characters": t.read("characters")}).filter("n > 0").collect()
        assert not broken and schemas.violations("characters", t.read("characters"), ids=True).filter("n > 0").count() == 0


def test_latest_is_kept_by_batches(spark, sf, tmp_path):
    rows = spark.createDataFrame([(k, k % 3, T0 + timedelta(hours=(k * 7) % 30), k) for k in range(60)], "id long, world_id long, scrape_time timestamp, players_online int")
    folder = str(tmp_path / "t")
    for k in (2, 0, 1, 0, 2):
        batch = rows.filter(F.col("id") % 4 == k)
        tables = run(spark, folder, f"b{k}", lambda stored: ingest.with_latest(stored, Changes(appended={"scrapes": batch})))  # noqa: B023
    late = rows.filter("id % 4 = 3")
    tables = run(spark, folder, "late", lambda stored: ingest.with_latest(stored, Changes(appended={"scrapes": late})))
    found = sorted(map(tuple, tables.read("scrapes_latest").select("world_id", "scrape_time", "players_online").collect()))
    assert found == sorted(map(tuple, snapshots.latest(rows).collect())) and tables.read("scrapes").count() == 60
    worlds = spark.createDataFrame([(k, f"w{k}") for k in range(3)], "id long, name string")
    files = snapshots.online_total(worlds, tables.read("scrapes_latest")).inputFiles()
    assert files and all("/scrapes_latest/" in f for f in files)


def test_one_world_opens_its_own_files(spark, tmp_path):
    rows = spark.range(20_000).select("id", (F.col("id") % 40).alias("world_id"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("scrape_time"), F.lit(1).alias("players_online"))
    tables = Tables(spark, str(tmp_path / "t")).commit("one", Changes(appended={"scrapes": rows}))
    start, end = F.lit(T0 + timedelta(days=3)), F.lit(T0 + timedelta(days=4))
    found = tables.of_key("scrapes", 7, (start, end))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(_bucket" in plan
    expected = rows.filter(F.to_date("scrape_time").between(F.to_date(start), F.to_date(end)) & (F.col("world_id") == 7)).count()
    assert found.count() == expected > 0
    scan = found._jdf.queryExecution().toRdd().getNumPartitions()
    metrics = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    assert metrics.apply("numFiles").value() <= 2 < len(tables.read("scrapes").inputFiles()) and scan <= 2
    two = tables.commit("two", Changes(appended={"scrapes": rows}))
    assert len(two.parts["scrapes"]) == 2 and len(two.compacted("scrapes").parts["scrapes"]) == 1
    assert Tables(spark, tables.folder).read("scrapes").count() == 40_000 and tables.read("scrapes").count() == 20_000
