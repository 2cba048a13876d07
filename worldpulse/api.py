"""The six questions as a service would ask them: unknown names raise ``LookupError``, rows come as data frames or JSON."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldpulse.functions.columns import CATEGORIES, horizon, iso_date, iso_instant, to_json
from worldpulse.operators import identity, snapshots, stats
from worldpulse.plans.tables import Tables
from worldpulse.sources.tables import vocations


def _literal(t: datetime):
    return F.lit(t.astimezone(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz").cast("timestamp") if t.tzinfo else F.lit(t)


@dataclass(frozen=True)
class Questions:
    """Tables in, answers out. ``as_of`` is the present; it is asked for each time, never frozen.

    ``latest``: the last snapshot of each world where it is kept; else it is worked out from all. ``stored``: tables whose layout
    finds one world's or character's rows without reading the others'.
    """

    worlds: DataFrame
    scrapes: DataFrame
    characters: DataFrame
    names: DataFrame
    records: DataFrame
    vocations: DataFrame
    latest: DataFrame | None = None
    stored: Tables | None = None

    @classmethod
    def over(cls, tables: Tables) -> Questions:
        """Over stored tables: answers about now read a row per world, those about one world or character its own files."""
        read = tables.read
        return cls(read("worlds"), read("scrapes"), read("characters"), read("character_names"), read("character_statrecords"), vocations(tables.spark), read("scrapes_latest"), tables)

    def _now(self) -> DataFrame:
        return self.scrapes if self.latest is None else self.latest

    def _world(self, name: str) -> int:
        """A world's id, a lookup of one row."""
        found = self.worlds.filter(F.col("name") == name).select("id").head(1)
        if not found:
            raise LookupError(f"no world is named {name}")
        return found[0]["id"]

    def _character(self, name: str, as_of: datetime) -> int:
        """The id of the character that a name belongs to. The names are searched once; what follows goes by the id."""
        found = identity.holders(self.names, horizon(_literal(as_of)), name).head(1)
        if not found or found[0]["id"] is None:
            raise LookupError(f"no character is or lately was named {name}")
        return found[0]["id"]

    def total(self) -> DataFrame:
        return snapshots.online_total(self.worlds, self._now())

    def online_by_world(self) -> DataFrame:
        """``(world, playersOnline)``."""
        return snapshots.worlds_online(self.worlds, self._now()).withColumnRenamed("players_online", "playersOnline")

    def online_in(self, name: str) -> DataFrame:
        self._world(name)
        return snapshots.world_now(self.worlds, self._now(), name).withColumnRenamed("players_online", "playersOnline")

    def history(self, name: str, start: datetime | None = None, end: datetime | None = None, as_of: datetime | None = None) -> DataFrame:
        """``(timestamp, playersOnline)`` in order; by default over the last day."""
        world, now = self._world(name), as_of or datetime.now(timezone.utc)
        first, last = _literal(start or now - timedelta(days=1)), _literal(end or now)
        rows = self.stored.of_key("scrapes", world, (first, last)) if self.stored else self.scrapes.filter(F.col("world_id") == world)
        found = rows.filter(F.col("scrape_time").between(first, last)).orderBy("scrape_time", "id")
        return found.select(iso_instant(F.col("scrape_time")).alias("timestamp"), F.col("players_online").alias("playersOnline"))

    def character(self, name: str, as_of: datetime | None = None) -> DataFrame:
        """``(id, name, level, vocationId, vocation, residence, lastLogin, status)``, with the name that was asked for."""
        found = self.characters.filter(F.col("id") == self._character(name, as_of or datetime.now(timezone.utc)))
        return answers(found.withColumn("requested_name", F.lit(name)), self.vocations)

    def stat_history(self, name: str, category: str, as_of: datetime | None = None) -> DataFrame:
        """``(date, value, rank, world)`` in order of date."""
        if category not in CATEGORIES:
            raise ValueError(f"{category} is no category")
        character = self._character(name, as_of or datetime.now(timezone.utc))
        rows = self.stored.of_key("character_statrecords", character) if self.stored else self.records.filter(F.col("character_id") == character)
        named = stats.by_category(rows, category).join(self.worlds.select(F.col("id").alias("world_id"), F.col("name").alias("world")), "world_id")
        return named.orderBy("date", "id").select(iso_date(F.col("date")).alias("date"), "value", "rank", "world")


def answers(found: DataFrame, known: DataFrame) -> DataFrame:
    """Character rows with ``requested_name`` as the service gives them: ``(id, name, level, vocationId, vocation, residence, lastLogin, status)``."""
    named = found.join(known.select(F.col("id").alias("vocation_id"), F.col("name").alias("vocation")), "vocation_id", "left")
    detail = {c.lower(): c for c in found.columns}
    given = [(F.col(detail[c]) if c in detail else F.lit(None)).cast("string").alias(out) for c, out in (("residence", "residence"), ("last_login", "lastLogin"), ("acc_status", "status"))]
    return named.select("id", F.col("requested_name").alias("name"), "level", F.col("vocation_id").alias("vocationId"), "vocation", *given)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row; nulls stay in it."""
    return rows.select(to_json(*rows.columns).alias("json"))


def graph_worlds(rows: DataFrame) -> DataFrame:
    """World rows under the graph API's column name."""
    return rows.withColumnRenamed("world", "name")
