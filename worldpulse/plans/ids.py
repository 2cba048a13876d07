"""Numbers for new rows: dense ones after the last that was given out, without bringing the rows together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldpulse.plans.store import staged

_IN_TASK = (1 << 33) - 1


def allocate(rows: DataFrame, column: str, after: int, staging: str) -> tuple[DataFrame, int]:
    """``rows`` with ``column``, null so far, numbered from ``after + 1`` on; and the last number.

    The rows are stored with their place in the task that writes them. A count per task gives each task's first number:
    a row per task goes to the driver, whatever the number of rows.
    """
    names = rows.columns
    placed = staged(rows.drop(column).withColumn("_at", F.monotonically_increasing_id()), staging, "ids")
    task = F.shiftright("_at", 33)
    counted = sorted(tuple(r) for r in placed.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())
    first, offsets = after, []
    for number, n in counted:
        offsets.append((number, first))
        first += n
    if not offsets:
        return placed.select(*[F.lit(None).cast("long").alias(c) if c == column else F.col(c) for c in names]), after
    starts = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_task long, _start long"))
    number = F.col("_start") + F.col("_at").bitwiseAND(F.lit(_IN_TASK)) + 1
    return placed.join(starts, task == F.col("_task")).withColumn(column, number).select(*names), first
