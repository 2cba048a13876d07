"""Characters whose names change: lookups by current or recent name, and the versioned name history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldpulse.functions.columns import split_names


def recent(cutoff: Column) -> Column:
    """Whether a name row is active, or was retired after ``cutoff``; rows without a state or date are neither."""
    return F.col("active") | (~F.col("active") & (F.col("inactive_date") > cutoff))


def holders(names: DataFrame, cutoff: Column, *wanted: str) -> DataFrame:
    """``(name, id)``: the character that bears each wanted name (all, if none is given) or bore it until after ``cutoff``.

    Of several the active one comes first, then the one retired last, then the lowest id.
    """
    found = names.filter(recent(cutoff))
    if wanted:
        found = found.filter(F.col("name").isin(*wanted))
    best = F.max_by("character_id", F.struct(F.col("active"), F.col("inactive_date"), -F.col("character_id")))
    return found.groupBy("name").agg(best.alias("id"))


def by_any_name(names: DataFrame, characters: DataFrame, cutoff: Column, *wanted: str) -> DataFrame:
    """The characters of :func:`holders`, with the wanted name as ``requested_name``."""
    return holders(names, cutoff, *wanted).withColumnRenamed("name", "requested_name").join(characters, "id")


def active_by_name(names: DataFrame, *wanted: str) -> DataFrame:
    return names.filter(F.col("name").isin(*wanted) & F.col("active"))


def active_by_character(names: DataFrame, *ids: int) -> DataFrame:
    return names.filter(F.col("character_id").isin(*ids) & F.col("active"))


def by_name(names: DataFrame, *wanted: str) -> DataFrame:
    """Name rows in any state."""
    return names.filter(F.col("name").isin(*wanted))


def new_id(*natural_key: Column | str) -> Column:
    """A surrogate id that is the same in every run and on every machine."""
    return F.xxhash64(*natural_key)


def resolve(seen: DataFrame, names: DataFrame, cutoff: Column) -> DataFrame:
    """``seen(name, former_names, seen_at)``, one row per name, with ``character_id`` and ``is_new``.

    A name belongs to the character that has it now or had it until after ``cutoff``; else to the one that
    has, or last had, one of its former names; else to a character that is new and has no id yet. A name is only looked up: a
    character's id says nothing about it, as a name may be given up and come back on another character.
    """
    own = holders(names, cutoff).withColumnRenamed("id", "own_id")
    parts = seen.select("name", F.explode(split_names(F.col("former_names"))).alias("former")).filter("former != name")
    held = names.filter("character_id is not null").groupBy(F.col("name").alias("former")).agg(F.max_by("character_id", F.struct("active", "inactive_date", -F.col("character_id"))).alias("former_id"))
    former = parts.join(held, "former").groupBy("name").agg(F.min("former_id").alias("former_id"))
    known = seen.join(own, "name", "left").join(former, "name", "left")
    found = F.coalesce("own_id", "former_id")
    return known.select(*seen.columns, found.alias("character_id"), found.isNull().alias("is_new"))


def name_changes(names: DataFrame, resolved: DataFrame) -> DataFrame:
    """The rows of ``names`` that change and those that are added after names were seen: a character seen under another name than its active one is renamed.

    The active version ends when the new one is seen; a character that is new gets its first version.
    The names of the characters that were seen are all it looks at; run again with the same rows it gives none.
    """
    until = names.schema["inactive_date"].dataType
    now = resolved.groupBy("character_id").agg(F.max_by(F.struct("name", "seen_at"), F.struct("seen_at", "name")).alias("now")).select("character_id", F.col("now.name").alias("now_name"), F.col("now.seen_at").alias("now_at"))
    ended = names.filter("active").join(now, "character_id").filter(F.col("now_name") != F.col("name"))
    closed = ended.select("id", "character_id", "name", F.lit(False).alias("active"), F.col("now_at").cast(until).alias("inactive_date"))
    has = names.filter("active").select("character_id", F.col("name").alias("now_name"))
    started = now.join(has, ["character_id", "now_name"], "left_anti")
    added = started.select(new_id(F.lit("name"), "character_id", "now_name", "now_at").alias("id"), "character_id", F.col("now_name").alias("name"), F.lit(True).alias("active"), F.lit(None).cast(until).alias("inactive_date"))
    return closed.unionByName(added)


def apply_names(names: DataFrame, resolved: DataFrame) -> DataFrame:
    """The whole name history after :func:`name_changes`."""
    changed = name_changes(names, resolved)
    return names.select("id", "character_id", "name", "active", "inactive_date").join(changed.select("id"), "id", "left_anti").unionByName(changed)


def history(observations: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Versions ``(key, value, valid_from, valid_to, active)`` from observations in time: one per change of value."""
    when = order[0]
    over = Window.partitionBy(key).orderBy(*order)
    changes = observations.withColumn("_before", F.lag(value).over(over)).withColumn("_first", F.row_number().over(over) == 1).filter(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before")))
    until = F.lead(when).over(over)
    return changes.select(key, value, F.col(when).alias("valid_from"), until.alias("valid_to"), until.isNull().alias("active"))
