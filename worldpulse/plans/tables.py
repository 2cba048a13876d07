"""The engine's tables below one folder, changed together by commits.

A commit names the folders ("parts") that each table consists of, the number up to which ids are given out, and the passes
that it holds. A pass writes new parts beside the others and then moves the log on by one rename (:mod:`commits`):
readers see all its tables or none, a pass that dies leaves the last commit as it was, of two passes at once one is refused,
and one that is run again under its name changes nothing. A merge writes only those files anew that hold one of its keys.

Tables that questions read by key have a layout: parts are partitioned by a hash of the key and, for snapshots, by day, and
files are sorted by key and time, so a question about one world or character opens few files and exchanges none of their rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worldpulse import schemas
from worldpulse.plans import commits
from worldpulse.plans.store import staged

#: Up to so many ids are looked for in the files by a filter of the scan.
FEW_IDS = 1_000
#: Passes are remembered by name this long; a pass isn't repeated after so many others.
REMEMBERED = 10_000


@dataclass(frozen=True)
class Layout:
    """Partitions by a hash of ``key`` and by the columns ``by``; files sorted by ``sort``."""

    key: str
    buckets: int
    sort: tuple[str, ...]
    day_of: str | None = None
    by: tuple[str, ...] = ()

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("long")), F.lit(self.buckets)).cast("int")

    def partitions(self) -> list[str]:
        return ["_bucket", *["_day"] * bool(self.day_of), *self.by]

    def arranged(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_bucket", self.bucket(F.col(self.key)))
        if self.day_of:
            rows = rows.withColumn("_day", F.to_date(self.day_of))
        return rows.repartition(*self.partitions()).sortWithinPartitions(*self.partitions(), *self.sort)


LAYOUTS = {
    "scrapes": Layout("world_id", 16, ("world_id", "scrape_time", "id"), day_of="scrape_time"),
    "character_statrecords": Layout("character_id", 64, ("character_id", "date", "id"), by=("category",)),
}
#: Besides the declared tables: the last snapshot of each world.
MAINTAINED = {"scrapes_latest": schemas.TABLES["scrapes"]}


def merged(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """``rows`` with those of ``changed`` in place of the ones of their ids."""
    return rows.join(changed.select("id"), "id", "left_anti").select(*changed.columns).unionByName(changed)


@dataclass
class Changes:
    """What a pass changes: next states, rows to append, rows to merge by ``id``, and the last ids that it has given out."""

    replaced: dict[str, DataFrame] = field(default_factory=dict)
    appended: dict[str, DataFrame] = field(default_factory=dict)
    merged: dict[str, DataFrame] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return next(kind[name] for kind in (self.replaced, self.merged, self.appended) if name in kind)


class Tables:
    """The tables as of the last commit; a later commit doesn't change what this object reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.at, state = commits.latest(spark, self.folder)
        self.parts: dict[str, list[str]] = state.get("parts", {})
        #: Files of parts whose rows a merge has written anew, by table and part.
        self.gone: dict[str, dict[str, list[str]]] = state.get("gone", {})
        self.marks: dict[str, int] = state.get("marks", {})
        self.passes: list[str] = state.get("passes", [])

    def schema(self, name: str) -> T.StructType:
        # Parquet has no columns that must not be null.
        declared = T.StructType.fromDDL(schemas.TABLES.get(name) or MAINTAINED[name])
        return T.StructType([T.StructField(f.name, f.dataType) for f in declared])

    def _rows(self, name: str) -> DataFrame:
        parts = self.parts.get(name)
        if not parts:
            empty = self.spark.createDataFrame([], self.schema(name))
            layout = LAYOUTS.get(name)
            return layout.arranged(empty) if layout else empty
        # Partition columns are read from the folders below the table's, of which ``part`` is the first.
        schema = self.schema(name)
        if name in LAYOUTS:
            extra = {"_bucket": T.IntegerType(), "_day": T.DateType()}
            schema = T.StructType([f for f in schema if f.name not in LAYOUTS[name].by] + [T.StructField(c, extra.get(c, T.StringType())) for c in LAYOUTS[name].partitions()])
        reader = self.spark.read.schema(T.StructType([*schema, T.StructField("part", T.StringType())])).option("basePath", f"{self.folder}/{name}")
        return reader.parquet(*[path for p in parts for path in self._paths(name, p)]).drop("part")

    def _paths(self, name: str, part: str) -> list[str]:
        """A part's folder, or, if a merge has taken files out of it, those that are left."""
        path, gone = f"{self.folder}/{name}/part={part}", set(self.gone.get(name, {}).get(part, ()))
        if not gone:
            return [path]
        listed = commits.files(self.spark, path).listStatus(commits.hadoop_path(self.spark, path))
        return [f"{path}/{n}" for s in listed if (n := s.getPath().getName())[0] not in "._" and n not in gone]

    def read(self, name: str) -> DataFrame:
        """A table with its declared columns."""
        return self._rows(name).select(*self.schema(name).names)

    def of_key(self, name: str, key: int, days: tuple[Column, Column] | None = None) -> DataFrame:
        """The rows of one key, from its partition alone; of snapshots those of some days, both included."""
        layout, rows = LAYOUTS[name], self._rows(name)
        found = rows.filter((F.col("_bucket") == layout.bucket(F.lit(key))) & (F.col(layout.key) == key))
        if days and layout.day_of:
            found = found.filter(F.col("_day").between(F.to_date(days[0]), F.to_date(days[1])))
        return found.select(*self.schema(name).names)

    def mark(self, name: str) -> int:
        """The last id that was given out for a table."""
        return self.marks.get(name, 0)

    def _write(self, name: str, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema(name)])
        layout = LAYOUTS.get(name)
        path = f"{self.folder}/{name}/part={part}"
        if layout:
            layout.arranged(rows).write.partitionBy(*layout.partitions()).parquet(path)
        else:
            # Sorted by id, files have ranges that a merge can tell from the footers; the Bloom filter tells which of these have a key.
            ordered = rows.repartitionByRange("id").sortWithinPartitions("id") if "id" in rows.columns else rows
            ordered.write.options(**{"parquet.bloom.filter.enabled#id": "true"}).parquet(path)
        return part

    def _merge(self, name: str, changed: DataFrame) -> tuple[list[str], dict[str, list[str]]]:
        """A table's parts, and files taken out of them, once ``changed`` has replaced or joined the rows of its ids.

        Only files that hold such an id are written anew, in one part with the changed rows; the others keep their names.
        """
        schema = self.schema(name)
        changed = staged(changed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]), f"{self.folder}/_staging", name)
        ids = [r["id"] for r in changed.select("id").limit(FEW_IDS + 1).collect()]
        if not ids:
            return self.parts.get(name, []), self.gone.get(name, {})
        touched = []
        if self.parts.get(name):
            stored = self._rows(name).select("id", F.col("_metadata.file_path").alias("file"))
            # Few ids go into the scan, where ranges and Bloom filters skip row groups; many are joined.
            held = stored.filter(F.col("id").isin(ids)) if len(ids) <= FEW_IDS else stored.join(changed.select("id"), "id", "left_semi")
            touched = [r["file"] for r in held.select("file").distinct().collect()]
        rewritten = changed
        if touched:
            rewritten = merged(self.spark.read.schema(schema).parquet(*touched), changed)
        gone = {p: list(files) for p, files in self.gone.get(name, {}).items()}
        for path in touched:
            part, file = path.rsplit("/", 2)[1:]
            gone.setdefault(part.removeprefix("part="), []).append(file)
        return [*self.parts.get(name, []), self._write(name, rewritten)], gone

    def commit(self, pass_id: str, changes: Changes) -> Tables:
        """The tables after a pass; as they are, if it is in them already. :class:`commits.Conflict` if another one came first."""
        if pass_id in self.passes:
            return self
        parts, gone = dict(self.parts), dict(self.gone)
        for name, rows in changes.replaced.items():
            parts[name], gone[name] = [self._write(name, rows)], {}
        for name, rows in changes.merged.items():
            parts[name], gone[name] = self._merge(name, rows)
        for name, rows in changes.appended.items():
            parts[name] = [*parts.get(name, []), self._write(name, rows)]
        content: dict[str, Any] = {"parts": parts, "gone": gone, "marks": self.marks | changes.marks, "passes": [*self.passes, pass_id][-REMEMBERED:]}
        commits.commit(self.spark, self.folder, self.at, content)
        return Tables(self.spark, self.folder)

    def compacted(self, *names: str) -> Tables:
        """Each table's parts as one; the rows stay the same."""
        return self.commit(f"compact-{uuid.uuid4().hex}", Changes(replaced={name: self.read(name) for name in names if len(self.parts.get(name, [])) > 1}))

    def vacuum(self) -> int:
        """Delete the parts and files that the last commit doesn't name; how many. Not while a pass is being written."""
        now = Tables(self.spark, self.folder)
        fs, gone = commits.files(self.spark, self.folder), 0
        for name in now.parts:
            kept = {f"part={p}" for p in now.parts[name]}
            for s in fs.listStatus(commits.hadoop_path(self.spark, f"{self.folder}/{name}")):
                if s.getPath().getName().startswith("part=") and s.getPath().getName() not in kept:
                    gone += bool(fs.delete(s.getPath(), True))
            for part, taken in now.gone.get(name, {}).items():
                for file in taken:
                    gone += bool(fs.delete(commits.hadoop_path(self.spark, f"{self.folder}/{name}/part={part}/{file}"), False))
        return gone


def run(spark: SparkSession, folder: str, pass_id: str, plan: Callable[[Tables], Changes], attempts: int = 3) -> Tables:
    """Plan and commit a pass; where another one was first, plan it again on the tables that one left."""
    while True:
        tables = Tables(spark, folder)
        if pass_id in tables.passes:
            return tables
        try:
            return tables.commit(pass_id, plan(tables))
        except commits.Conflict:
            attempts -= 1
            if not attempts:
                raise
