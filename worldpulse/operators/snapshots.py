"""Questions about periodic population snapshots, and first and last values per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(scrapes: DataFrame) -> DataFrame:
    """The last snapshot of each world as ``(world_id, scrape_time, players_online)``; of equal times the higher id wins.

    A partial maximum per task goes to the shuffle, so a world with a third of all snapshots costs a row per task.
    """
    best = F.max_by(F.struct("scrape_time", "players_online"), F.struct("scrape_time", "id"))
    return scrapes.groupBy("world_id").agg(best.alias("last")).select("world_id", "last.*")


def latest_rows(scrapes: DataFrame) -> DataFrame:
    """As :func:`latest`, with each snapshot's id, so that later snapshots can be merged in: the latest of some latest rows and
    new ones are those of all."""
    best = F.max_by(F.struct("id", "scrape_time", "players_online"), F.struct("scrape_time", "id"))
    return scrapes.groupBy("world_id").agg(best.alias("last")).select("last.id", "world_id", "last.scrape_time", "last.players_online")


def latest_by_rank(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The whole last row of each key by ``order`` (ascending): a limited window, which also reduces before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[o.desc() for o in order]))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def first_known(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The first value of each key that isn't null: once known, an attribute is never replaced."""
    return rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def online_total(worlds: DataFrame, scrapes: DataFrame) -> DataFrame:
    """One row ``(total)``: the sum over worlds of their last snapshot. Worlds without one are skipped; no world gives 0."""
    now = latest(scrapes).join(worlds.select(F.col("id").alias("world_id")), "world_id")
    return now.agg(F.coalesce(F.sum("players_online"), F.lit(0)).cast("int").alias("total"))


def worlds_online(worlds: DataFrame, scrapes: DataFrame) -> DataFrame:
    """``(world, players_online)`` of every world; 0 without a snapshot."""
    now = latest(scrapes).select(F.col("world_id").alias("id"), "players_online")
    return worlds.select("id", F.col("name").alias("world")).join(now, "id", "left").select("world", F.coalesce("players_online", F.lit(0)).alias("players_online"))


def world_now(worlds: DataFrame, scrapes: DataFrame, *names: str) -> DataFrame:
    """As :func:`worlds_online` for the worlds named exactly so. They are few, so they meet the snapshots before these are reduced."""
    wanted = worlds.filter(F.col("name").isin(*names))
    own = scrapes.join(wanted.select(F.col("id").alias("world_id")), "world_id", "left_semi")
    return worlds_online(wanted, own)


def world_history(worlds: DataFrame, scrapes: DataFrame, name: str, start: Column, end: Column) -> DataFrame:
    """``(scrape_time, players_online)`` of one world from ``start`` to ``end``, both included, in order of time and id."""
    wanted = worlds.filter(F.col("name") == name).select(F.col("id").alias("world_id"))
    found = scrapes.filter(F.col("scrape_time").between(start, end)).join(wanted, "world_id", "left_semi")
    return found.orderBy("scrape_time", "id").select("scrape_time", "players_online")


def worlds_without_snapshot(worlds: DataFrame, scrapes: DataFrame) -> DataFrame:
    return worlds.join(scrapes.select(F.col("world_id").alias("id")), "id", "left_anti").select("id", "name")


def daily_counts(scrapes: DataFrame) -> DataFrame:
    """``(day, world_id, n)``: snapshots per day (UTC) and world. An addition; the read model itself has no windows."""
    return scrapes.groupBy(F.to_date("scrape_time").alias("day"), "world_id").agg(F.count("*").alias("n"))


def page_of(rows: DataFrame, size: int, number: int, *order: str) -> DataFrame:
    """Page ``number`` (from 0) of ``rows`` in a total order: the planner takes the first rows of each partition, no full sort."""
    return rows.orderBy(*order).offset(size * number).limit(size)
