"""Helpers that several operators of this subpackage use: own columns, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine may do without it (tests): it gets a temporary folder, removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="worldpulse-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return _local["dir"]


def own_dir(spark: SparkSession) -> str:
    """This application's part of the scratch folder."""
    return f"{scratch_dir(spark)}/worldpulse/{spark.sparkContext.applicationId}"


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def exchanges_deleted(spark: SparkSession) -> Iterator[None]:
    """Files of exchanges that are made inside are deleted once their query has ended; the session's setting stays as it was."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def store(df: DataFrame, path: str, **options: str) -> None:
    """Write ``df`` as Parquet. Its exchanges' files are deleted at once, as nothing reads them any more."""
    with exchanges_deleted(df.sparkSession):
        df.write.options(**options).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage with files that outlive any executor. Names are unique, so that a
    second run never sees the rows of the first. :func:`clear` removes them once results are written.
    """
    path = f"{own_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    store(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows from the driver as a table, inside the plan itself: no Python worker takes part."""
    of = T.StructType.fromDDL(schema)
    text = json.dumps([_plain(of, r) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), T.ArrayType(of))))


def _plain(of: T.DataType, value: Any) -> Any:
    if isinstance(of, T.StructType):
        return {f.name: _plain(f.dataType, v) for f, v in zip(of, value, strict=True)}
    return [_plain(of.elementType, v) for v in value] if isinstance(of, T.ArrayType) else value


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Results that haven't been written by then can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, limit: str = "4m") -> None:
    """Let Arrow batches hold at most ``limit``; a task has a few of them at a time, in and out, beside its tables."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *taken: str) -> list[str]:
    """The columns of ``df`` but those named like one of ``taken``, in any case of letters."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


def pack(df: DataFrame, keep: list[str], **new: Column) -> DataFrame:
    """``df`` as one struct ``row`` of the columns ``keep`` beside ``new`` ones, so that no name inside can clash with one outside."""
    row = F.struct(*[named(c) for c in keep]) if keep else F.struct(F.lit(True).alias("none"))
    return df.select(row.alias("row"), *[c.alias(name) for name, c in new.items()])


def unpack(keep: list[str]) -> list[Column]:
    """The packed columns under their own names."""
    return [F.col("row").getField(c).alias(c) for c in keep]


def hot_join(many: DataFrame, one: DataFrame, key: str | list[str], share: int = 1_000, how: str = "inner") -> DataFrame:
    """The inner (or left) join of ``many`` rows per key with ``one`` row per key, where a key may hold a large part of ``many``.

    Keys with more than a ``share``-th of the rows are fewer than ``share``, whatever the input's size: their rows
    of ``one`` are broadcast, so theirs in ``many`` stay where they are. Only the rest is exchanged. Both
    sides are stored tables.
    """
    counted = many.groupBy(key).agg(F.count("*").alias("n"))
    total = many.count()
    hot = F.broadcast(counted.filter(F.col("n") > max(1, total // share)).select(key))
    there = F.broadcast(one.join(hot, key, "left_semi"))
    own = many if how == "inner" else many.join(hot, key, "left_semi")
    return own.join(there, key, how).unionByName(many.join(hot, key, "left_anti").join(one, key, how))


_held: dict[Hashable, Any] = {}


def one_per_process(key: Hashable, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept by this Python process until another key is asked for.

    Workers are reused from stage to stage; holding one operator's tables at a time bounds their memory.
    """
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def let_go() -> None:
    """Drop what this process holds, and give free memory back; for tasks that need no tables and run in a worker that made some."""
    _held.clear()
    pa.default_memory_pool().release_unused()
