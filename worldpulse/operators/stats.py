"""Character scores over time, and the grid of pages that a highscore run reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldpulse.functions.columns import CATEGORIES

VOCATION_IDS = (1, 2, 3, 4, 5, 6)
MAX_PAGES = 20


def by_category(stats: DataFrame, category: str) -> DataFrame:
    return stats.filter(F.col("category") == category)


def stat_history(found: DataFrame, stats: DataFrame, worlds: DataFrame, category: str) -> DataFrame:
    """``(requested_name, date, value, rank, world)`` of the characters in ``found(id, requested_name)``, by date and id.

    Characters and worlds are dimension rows; the filter on the category reaches the scan of the scores.
    """
    own = by_category(stats, category).join(found.select(F.col("id").alias("character_id"), "requested_name"), "character_id")
    named = own.join(worlds.select(F.col("id").alias("world_id"), F.col("name").alias("world")), "world_id")
    return named.orderBy("requested_name", "date", "id").select("requested_name", "date", "value", "rank", "world")


def highscore_grid(worlds: DataFrame, pages: int = MAX_PAGES) -> DataFrame:
    """Every list page to read, ``(world, category, vocation_id, page)``: fixed lists of 15 by 6 by ``pages`` per world, exploded in place."""
    lists = worlds.select(F.col("name").alias("world"), F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    lists = lists.withColumn("vocation_id", F.explode(F.array(*map(F.lit, VOCATION_IDS))))
    return lists.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))


def read_pages(rows: DataFrame) -> DataFrame:
    """Rows of ``(world, category, vocation_id, page, …)`` as a run would read them: up to the first empty page, 20 at most."""
    lists = ["world", "category", "vocation_id"]
    seen = rows.filter(F.col("page").between(1, MAX_PAGES)).groupBy(*lists).agg(F.collect_set("page").alias("_pages"))
    # At most 20 numbers: the first that's missing ends the list.
    missing = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(MAX_PAGES + 1)), "_pages"))
    ends = seen.select(*lists, missing.alias("_end"))
    return rows.join(ends, lists).filter(F.col("page") < F.col("_end")).drop("_end")
