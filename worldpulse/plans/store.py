"""Writing tables: appends, and replacing a table with its next state.

A replaced table is a folder of versions and a small file that names the current one. The next version is written
beside the others, then the file is replaced by one atomic rename, so a reader gets the old table or the new one, and
a run that fails leaves the old one. Older versions stay for readers that have begun, until :func:`vacuum`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from worldpulse.plans.commits import files as _files
from worldpulse.plans.commits import hadoop_path as _path
from worldpulse.plans.commits import read_text, rename_text

CURRENT = "_CURRENT"
_local: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's path below the one that the cluster names in ``spark.checkpoint.dir``, for what a query stores on its way.

    Only a session on one machine may do without that setting (tests): it gets a temporary folder, removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="worldpulse-")
            atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
        named = _local["dir"]
    return f"{named.rstrip('/')}/worldpulse/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def append(rows: DataFrame, folder: str, name: str, *partition_by: str) -> None:
    """Append rows as Parquet, in folders by ``partition_by`` (stat records: their category and date); for tables that only grow."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(f"{folder}/{name}")


def current(spark: SparkSession, folder: str, name: str) -> str | None:
    """The folder of a replaced table's current version."""
    version = read_text(spark, f"{folder}/{name}/{CURRENT}")
    return f"{folder}/{name}/{version}" if version else None


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A replaced table as it is now."""
    path = current(spark, folder, name)
    if path is None:
        raise FileNotFoundError(f"{folder}/{name} has no current version")
    return spark.read.parquet(path)


def replace(rows: DataFrame, folder: str, name: str, *sort_by: str) -> None:
    """Replace a table by ``rows``, which may be derived from it. ``sort_by`` clusters files, so that row groups can be skipped by a key."""
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    (rows.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else rows).write.parquet(f"{folder}/{name}/{version}")
    rename_text(spark, f"{folder}/{name}/{CURRENT}", version, overwrite=True)


def vacuum(spark: SparkSession, folder: str, name: str) -> int:
    """Delete all versions but the current one; how many there were."""
    kept = current(spark, folder, name)
    fs = _files(spark, folder)
    old = [s.getPath() for s in fs.listStatus(_path(spark, f"{folder}/{name}")) if s.isDirectory() and s.getPath().getName() != (kept or "").rsplit("/", 1)[-1]]
    for path in old:
        fs.delete(path, True)
    return len(old)


def staged(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """``rows`` written once below ``folder`` and read back, for plans that several results are taken from."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def exists(spark: SparkSession, folder: str, name: str) -> bool:
    return _files(spark, folder).exists(_path(spark, f"{folder}/{name}"))
