"""A reader of stored tables, seed rows, and page addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worldpulse import schemas
from worldpulse.functions.columns import category_code

#: The seeded vocations with their promotions, ids 1 to 5.
VOCATIONS = (
    ("druid", "elder druid"),
    ("sorcerer", "master sorcerer"),
    ("knight", "elite knight"),
    ("paladin", "royal paladin"),
    ("monk", "exalted monk"),
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the engine's tables from Parquet, with its declared schema, so no file is opened to infer one."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}")


def vocations(spark: SparkSession) -> DataFrame:
    rows = [(k, name, promoted) for k, (name, promoted) in enumerate(VOCATIONS, 1)]
    return spark.createDataFrame(rows, schemas.TABLES["vocations"])


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files as ``(url, fetched_at, html)``; fetching itself happens outside the engine."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), F.col("modificationTime").alias("fetched_at"), F.decode("content", "UTF-8").alias("html"))


# The addresses' patterns, here and in the three functions that follow.
def world_list_url(base: Column) -> Column:
    return F.concat(base, F.lit("?subtopic=worlds"))


def world_url(base: Column, world: Column) -> Column:
    return F.concat(world_list_url(base), F.lit("&world="), world)


def character_url(base: Column, name: Column) -> Column:
    return F.concat(base, F.lit("?name="), F.url_encode(name))


def highscore_url(base: Column, world: Column, vocation_id: Column, category: Column, page: Column) -> Column:
    return F.concat(base, F.format_string("?subtopic=highscores&world=%s&beprotection=-1&profession=%d&category=%d&currentpage=%d", world, vocation_id, category_code(category), page))
