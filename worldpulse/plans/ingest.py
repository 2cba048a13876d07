"""The two write paths: a pass over world pages, and a run over highscore pages.

:func:`world_pass` and :func:`highscore_run` take landed pages and tables and return what changes; :func:`run_world_pass`
and :func:`run_highscores` plan them on stored tables and commit all of it at once, under the pass's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worldpulse.operators.identity import holders, name_changes, new_id, resolve
from worldpulse.operators.snapshots import latest_rows
from worldpulse.operators.stats import read_pages
from worldpulse.plans.ids import allocate
from worldpulse.plans.store import staged
from worldpulse.plans.tables import Changes, Tables, run

ATTRIBUTES = ("online_record", "creation_date", "transfer_type", "game_world_type")
DETAILS = {"sex": "string", "vocation_id": "bigint", "level": "int", "achievement_points": "int", "residence": "string", "last_login": "timestamp", "acc_status": "string", "creation_date": "timestamp"}


def upsert_worlds(worlds: DataFrame, overview: DataFrame, pages: DataFrame) -> DataFrame:
    """The worlds table after a pass: new names are added, attributes are filled where they are null, known ones stay.

    ``overview(name, pvp_type, location)``; ``pages(name, fetched_at, …attributes)`` as world pages give them, of which the
    first to know an attribute gives it. A new world's type and location come from the overview; should it list a world twice,
    the least value is taken, as its rows have no order.
    """
    listed = overview.groupBy("name").agg(F.min("pvp_type").alias("o_pvp"), F.min("location").alias("o_location"))
    # The value breaks ties of time.
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("fetched_at", c))).alias(f"p_{c}") for c in ("pvp_type", *ATTRIBUTES)]
    merged = worlds.join(listed, "name", "full").join(pages.groupBy("name").agg(*first), "name", "left")
    return merged.select(
        F.coalesce("id", new_id(F.lit("world"), F.col("name"))).alias("id"),
        "name",
        F.coalesce("pvp_type", "o_pvp", "p_pvp_type").alias("pvp_type"),
        F.coalesce("location", "o_location").alias("location"),
        *[F.coalesce(c, f"p_{c}").alias(c) for c in ATTRIBUTES],
    ).select("id", "name", "pvp_type", "location", "online_record", "creation_date", "transfer_type", "game_world_type")


def _numbered(resolved: DataFrame, after: int, staging: str) -> tuple[DataFrame, int]:
    """``resolved``, stored, with ids for the new characters; and the last id."""
    resolved = staged(resolved, staging, "resolved")
    fresh, last = allocate(resolved.filter("is_new"), "character_id", after, staging)
    return resolved.filter("not is_new").unionByName(fresh), last


def last_character(names: DataFrame) -> int:
    """The highest id in use, for tables whose mark isn't stored."""
    return names.agg(F.max("character_id")).first()[0] or 0


def world_pass(worlds: DataFrame, names: DataFrame, overview: DataFrame, pages: DataFrame, former: DataFrame, as_of: Column, staging: str, after: int | None = None) -> Changes:
    """One pass over all worlds of ``overview``.

    ``pages(name, fetched_at, players_online, …attributes, players)``: parsed world pages; each snapshot is
    stamped with its own page's time. ``former(name, former_names)``: parsed character pages. The folder ``staging`` takes pages
    and resolved names, so that they are worked out once, not once per result; ``after`` is the last character id in use.
    """
    own = staged(pages.join(overview.select("name").distinct(), "name", "left_semi"), staging, "pages")
    next_worlds = staged(upsert_worlds(worlds, overview, own), staging, "worlds")
    stamped = own.join(next_worlds.select("name", F.col("id").alias("world_id")), "name")
    scrape_id = new_id(F.lit("scrape"), "world_id", "fetched_at")
    scrapes = stamped.select(scrape_id.alias("id"), "world_id", F.col("fetched_at").alias("scrape_time"), "players_online")
    online = stamped.select(scrape_id.alias("scrape_id"), "fetched_at", F.explode("players").alias("player"))
    seen = online.groupBy(F.col("player").alias("name")).agg(F.max("fetched_at").alias("seen_at"))
    listed = former.groupBy("name").agg(F.min("former_names").alias("former_names"))
    asked = seen.join(listed, "name", "left").withColumn("former_names", F.coalesce("former_names", "name"))
    resolved, last = _numbered(resolve(asked, names, as_of - F.make_interval(months=F.lit(6))), last_character(names) if after is None else after, staging)
    players = online.join(resolved.select(F.col("name").alias("player"), "character_id"), "player")
    # Most worlds and names are as they were: only what differs is merged in.
    changed_worlds = next_worlds.join(worlds, [next_worlds[c].eqNullSafe(worlds[c]) for c in next_worlds.columns], "left_anti")
    return Changes(
        merged={"worlds": changed_worlds, "character_names": name_changes(names, resolved)},
        appended={
            "scrapes": scrapes,
            "characters": new_characters(resolved),
            "scrape_players": players.select(new_id(F.lit("seen"), "scrape_id", "character_id").alias("id"), "scrape_id", "character_id").distinct(),
        },
        marks={"characters": last},
    )


def new_characters(resolved: DataFrame) -> DataFrame:
    """Character rows to append; all that pages of other kinds would tell is null."""
    return resolved.filter("is_new").select(F.col("character_id").alias("id"), *[F.lit(None).cast(t).alias(c) for c, t in DETAILS.items()])


def highscore_run(worlds: DataFrame, names: DataFrame, rows: DataFrame, as_of: Column, staging: str, after: int | None = None) -> Changes:
    """One highscore run over parsed rows ``(world, category, vocation_id, page, rank, name, value)``.

    Every record has the run's one date and time. A name counts as known while it is active; any other gets a
    new character and a first name version.
    """
    read = staged(read_pages(rows), staging, "rows")
    active = names.filter("active").groupBy("name").agg(F.min("character_id").alias("character_id"))
    listed = read.select("name").distinct().join(active, "name", "left").select("name", "character_id", F.col("character_id").isNull().alias("is_new"))
    seen, last = _numbered(listed, last_character(names) if after is None else after, staging)
    placed = read.join(seen, "name").join(worlds.select(F.col("name").alias("world"), F.col("id").alias("world_id")), "world")
    records = placed.select(
        new_id(F.lit("stat"), "world_id", "category", "vocation_id", "page", "rank", "name", as_of).alias("id"),
        "character_id",
        "category",
        F.to_date(as_of).alias("date"),
        "value",
        "rank",
        "world_id",
        as_of.alias("scraped_at"),
        F.col("vocation_id").cast("bigint").alias("vocation_id"),
    )
    fresh = seen.filter("is_new")
    added = fresh.select(new_id(F.lit("name"), "character_id", "name", as_of).alias("id"), "character_id", "name", F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("inactive_date"))
    return Changes(appended={"character_statrecords": records, "characters": new_characters(seen), "character_names": added}, marks={"characters": last})


def missing_names(names: DataFrame, players: DataFrame, as_of: Column) -> DataFrame:
    """Names among ``players(name)`` that no character has or lately had: their pages are to be fetched."""
    return players.select("name").distinct().join(holders(names, as_of - F.make_interval(months=F.lit(6))).select("name"), "name", "left_anti")


def with_latest(tables: Tables, changes: Changes) -> Changes:
    """The changes and, from their snapshots, those of the stored last snapshot per world: a merge of one row per world with the new ones."""
    if "scrapes" in changes.appended:
        names = tables.schema("scrapes").names
        changes.replaced["scrapes_latest"] = latest_rows(tables.read("scrapes_latest").unionByName(changes.appended["scrapes"].select(*names)))
    return changes


def run_world_pass(spark: SparkSession, folder: str, pass_id: str, overview: DataFrame, pages: DataFrame, former: DataFrame, as_of: Column) -> Tables:
    """A pass over the tables below ``folder``, committed as one. Run again, under the same name, it changes nothing."""

    def plan(tables: Tables) -> Changes:
        changes = world_pass(tables.read("worlds"), tables.read("character_names"), overview, pages, former, as_of, f"{folder}/_staging/{pass_id}", tables.mark("characters"))
        return with_latest(tables, changes)

    return run(spark, folder, pass_id, plan)


def run_highscores(spark: SparkSession, folder: str, pass_id: str, rows: DataFrame, as_of: Column) -> Tables:
    """A highscore run over the tables below ``folder``, committed as one."""
    return run(spark, folder, pass_id, lambda tables: highscore_run(tables.read("worlds"), tables.read("character_names"), rows, as_of, f"{folder}/_staging/{pass_id}", tables.mark("characters")))
