"""Deleting rows with all that refers to them, along the tables' references."""

from __future__ import annotations

from collections.abc import Mapping
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldpulse.schemas import CASCADES, REFERENCES


def order(references: Mapping[tuple[str, str], str] = REFERENCES) -> list[str]:
    """The tables, each after those that it refers to."""
    parents: dict[str, set[str]] = {}
    for (child, _), target in references.items():
        parents.setdefault(child, set()).add(target)
    return list(TopologicalSorter(parents).static_order())


def delete(tables: Mapping[str, DataFrame], removed: Mapping[str, DataFrame], references: Mapping[tuple[str, str], str] = REFERENCES) -> dict[str, DataFrame]:
    """What is left of each table once ``removed[table](id)`` are deleted, and with them every row that refers to a deleted one.

    Tables are taken in the order of their references, so a row's parents are settled before it, over any number of levels;
    each reference costs an anti-join, and a semi-join for the ids that go on if other tables refer to this one. A reference that may be null is
    emptied instead: its row stays. Tables that nothing removed is above are returned as they are.
    """
    gone = {t: ids.select("id").distinct() for t, ids in removed.items()}
    left = dict(tables)
    above = set(references.values())
    for name in order(references):
        if name not in tables:
            continue
        rows = tables[name]
        if name in removed:
            rows = left[name] = rows.join(gone[name], "id", "left_anti")
        for (child, column), target in references.items():
            if child != name or target not in gone:
                continue
            ids = gone[target].select(F.col("id").alias(column))
            if CASCADES.get((child, column)) == "set null":
                marked = rows.join(ids.withColumn("_lost", F.lit(True)), column, "left")
                rows = marked.select(*[F.when(F.col("_lost").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])
            else:
                rows = rows.join(ids, column, "left_anti").select(*rows.columns)
                if name in above:
                    lost = tables[name].join(ids, column, "left_semi").select("id")
                    gone[name] = (gone[name].unionByName(lost) if name in gone else lost).distinct()
            left[name] = rows
    return left


def _lost(rows: DataFrame, removed: DataFrame, column: str) -> DataFrame:
    return rows.join(removed.select(F.col("id").alias(column)).distinct(), column, "left_semi")


def refused(tables: Mapping[str, DataFrame], removed: Mapping[str, DataFrame], references: Mapping[tuple[str, str], str] = REFERENCES) -> DataFrame:
    """``(table, column, n)``: rows that would keep a database from deleting ``removed``, as they refer to what goes by a reference
    that neither cascades nor is emptied."""
    own = {k: v for k, v in references.items() if CASCADES.get(k) == "cascade"}
    gone = {t: ids.select("id") for t, ids in removed.items()}
    for name in order(references):
        for (child, column), target in own.items():
            if child == name and child in tables and target in gone:
                ids = _lost(tables[child], gone[target], column).select("id")
                gone[child] = gone[child].unionByName(ids) if child in gone else ids
    out = next(iter(tables.values())).sparkSession.createDataFrame([], "table string, column string, n bigint")
    for (child, column), target in references.items():
        if child in tables and target in gone and (child, column) not in CASCADES:
            rows = tables[child].join(gone[child].distinct(), "id", "left_anti") if child in gone else tables[child]
            out = out.unionByName(_lost(rows, gone[target], column).agg(F.count("*").alias("n")).select(F.lit(child).alias("table"), F.lit(column).alias("column"), "n"))
    return out
