"""The same questions on a stream of snapshots, and the sinks that keep tables up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from worldpulse.operators.snapshots import latest

SNAPSHOT_SECONDS = 60


def snapshot_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Snapshots that land as Parquet files. Times without a zone are read as UTC, as watermarks need instants."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(path)
    return rows.withColumn("scrape_time", F.col("scrape_time").cast("timestamp"))


def live_latest(scrapes: DataFrame) -> DataFrame:
    """The last snapshot per world; in update mode each trigger gives the worlds that changed. State: a row per world."""
    return latest(scrapes)


def without_repeats(scrapes: DataFrame, late_by: str = "10 minutes") -> DataFrame:
    """Each snapshot once, even if its page lands twice within the watermark."""
    return scrapes.withWatermark("scrape_time", late_by).dropDuplicatesWithinWatermark(["world_id", "scrape_time"])


def windowed_counts(scrapes: DataFrame, width: str, slide: str | None = None, late_by: str = "10 minutes") -> DataFrame:
    """Snapshots and their largest population per window and world; in append mode a window comes out once the watermark is past it."""
    window = F.window("scrape_time", width, slide) if slide else F.window("scrape_time", width)
    grouped = scrapes.withWatermark("scrape_time", late_by).groupBy(window.alias("w"), "world_id")
    return grouped.agg(F.count("*").alias("n"), F.max("players_online").alias("peak")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "world_id", "n", "peak")


def sessions(scrapes: DataFrame, gap: str, late_by: str = "10 minutes") -> DataFrame:
    """Runs of snapshots of a world without a pause longer than ``gap``."""
    grouped = scrapes.withWatermark("scrape_time", late_by).groupBy(F.session_window("scrape_time", gap).alias("w"), "world_id")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "world_id", "n")


def scores_near(scrapes: DataFrame, records: DataFrame, within: str = "15 minutes", late_by: str = "10 minutes") -> DataFrame:
    """Score records with the snapshots of their world that were taken ``within`` that time of them; of two streams or two tables.

    Both sides have watermarks and the times a bound, so either side's state is dropped once the other can't match it any more.
    """
    s = scrapes.select("world_id", F.col("scrape_time").cast("timestamp").alias("scrape_time"), "players_online").withWatermark("scrape_time", late_by)
    r = records.select(F.col("world_id").alias("of_world"), "character_id", "category", "value", F.col("scraped_at").cast("timestamp").alias("scraped_at")).withWatermark("scraped_at", late_by)
    near = F.expr(f"world_id = of_world and scrape_time >= scraped_at - interval {within} and scrape_time <= scraped_at + interval {within}")
    return s.join(r, near).drop("of_world")


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hand each batch to ``sink``, every minute or, with ``once``, until what is there is read (for a scheduler's daily run)."""
    writer = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{SNAPSHOT_SECONDS} seconds")).start()


def append_sink(folder: str, name: str) -> Callable[[DataFrame, int], None]:
    """Append a batch in a folder of its number: a batch that is run again replaces its own rows only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return write
