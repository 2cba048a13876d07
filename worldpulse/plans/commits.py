"""A numbered log of commits below a folder: what a set of tables consists of, moved on by one rename.

A commit is a small JSON file, written aside and renamed to the next number. The rename doesn't overwrite, so of two
writers that began with the same commit one succeeds and the other gets :class:`Conflict`; a reader sees all of a commit
or none of it, and a writer that dies leaves only files that no commit names.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

LOG = "_commits"


class Conflict(RuntimeError):
    """Somebody else has committed since this writer began."""


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def files(spark: SparkSession, path: str):
    """The file system that holds ``path``."""
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = files(spark, path), hadoop_path(spark, path)
    if not fs.exists(at):
        return None
    file = fs.open(at)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def rename_text(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    """``text`` under ``path`` by one rename, so that nobody reads a part of it. Without ``overwrite`` an existing file is :class:`Conflict`."""
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    out = files(spark, aside).create(hadoop_path(spark, aside))
    try:
        out.write(text.encode())
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE if overwrite else getattr(hadoop, "Options$Rename").NONE
    context = hadoop.FileContext.getFileContext(files(spark, aside).getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(hadoop_path(spark, aside), hadoop_path(spark, path), how)
    except Exception as e:
        files(spark, aside).delete(hadoop_path(spark, aside), False)
        if not overwrite and files(spark, path).exists(hadoop_path(spark, path)):
            raise Conflict(f"{path} has been written by somebody else") from e
        raise


def latest(spark: SparkSession, folder: str) -> tuple[int, dict[str, Any]]:
    """Number and content of the last commit; ``(0, {})`` before the first."""
    log = f"{folder}/{LOG}"
    fs = files(spark, log)
    if not fs.exists(hadoop_path(spark, log)):
        return 0, {}
    numbers = [int(n.removesuffix(".json")) for s in fs.listStatus(hadoop_path(spark, log)) if (n := s.getPath().getName()).endswith(".json") and n[0] != "."]
    last = max(numbers, default=0)
    return last, json.loads(read_text(spark, f"{log}/{last:012d}.json")) if last else {}


def commit(spark: SparkSession, folder: str, after: int, content: dict[str, Any]) -> int:
    """The number of the new commit, the one next to ``after``."""
    rename_text(spark, f"{folder}/{LOG}/{after + 1:012d}.json", json.dumps(content), overwrite=False)
    return after + 1
