"""Operator 11, line deduplication by levelled sorted runs of line hashes.

A line's key is the line without white space (space and 9 to 13) at its ends, A-Z in lower case. Keys of at least
``least_chars`` code points that ``least_docs`` documents or more have lose all their lines but those of one document, the
holder. :class:`LineRuns` keeps what is known of keys in runs, each sorted and bucketed by the key's 128-bit hash:

- :meth:`LineRuns.add` takes a batch of documents, reduces it to a row per key, *merge-anti-joins* it with the runs, and
  adds it as a run of its own. A key that no run has is new: its holder is the batch's largest id with it. One that
  some run has already adds only its count. The runs' side is neither exchanged nor, with a file per bucket, sorted again.
- *Compaction*: as soon as a level has two runs they are merged, bucket by bucket, into one of the next level. So a
  key is written once a level, and there are as many runs as the number of batches has binary ones.
- The runs and the batches in them are named by a log of commits. A batch that is added again, after a writer's death, changes
  nothing, and of two writers at once one is refused. :meth:`LineRuns.open` finds the runs of an earlier application.

:func:`dedup` does this for a whole table: it takes documents in ``batches`` by descending id, so the batch that has a key
first has its largest id, then lets the merged runs judge the lines. The number of batches is fixed, as every one reads all runs.

Null and empty texts are one empty line. A document is an id: rows of one id count once, and each of them keeps the
lines that its id holds. Rows without an id count as one document that comes after all others. Equal lines within a document
are judged alike. Very long texts are worked line by line within one row. An empty table gives no rows.
Extra columns pass through under any name; one named like an output is replaced by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldpulse.llm.shared import hot_join, let_go, materialize, named, others, own_dir, pack, unpack
from worldpulse.plans import commits

OUTPUTS = ("n_lines", "n_dropped", "kept")
BATCHES = 4
_ENDS = " \t\n\v\f\r"
KEY = ["h1", "h2"]


def _keys(lines: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are long enough, and the two halves of the hashes of their keys."""
    keys = pc.utf8_trim(lines, characters=_ENDS)
    long = pc.greater_equal(pc.utf8_length(keys), least_chars)
    wanted = pc.cast(pc.ascii_lower(keys.filter(long)), pa.large_binary()).to_pylist()
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, wanted)), ">i8").reshape(-1, 2)
    return long.to_numpy(zero_copy_only=False), digests.astype(np.int64)


def _entries(least_chars: int):
    """A row for each text's distinct keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            lists = pc.split_pattern(pc.cast(pc.fill_null(batch.column("text"), ""), pa.large_string()), "\n")
            long, digests = _keys(lists.flatten(), least_chars)
            row = pc.list_parent_indices(lists).to_numpy()[long]
            first = np.unique(np.column_stack([row, digests]), axis=0) if len(row) else np.zeros((0, 3), np.int64)
            at = pa.array(first[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column("batch").take(at), batch.column("doc_id").take(at), batch.column("digest").take(at), pa.array(first[:, 1]), pa.array(first[:, 2])], names=["batch", "doc_id", "digest", *KEY])

    return emit


def _kept(least_chars: int):
    """Each text without the lines whose keys are listed beside it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            texts, gone = pc.fill_null(batch.column("text"), ""), batch.column("gone")
            n_lines, n_dropped, kept = [], [], []
            for k, text in enumerate(texts):
                listed = gone[k].values
                lines = text.as_py().split("\n")
                dropped = np.zeros(len(lines), bool)
                if listed is not None and len(listed):
                    long, digests = _keys(pa.array(lines, pa.large_string()), least_chars)
                    bad = set(zip(listed.field(0).to_pylist(), listed.field(1).to_pylist(), strict=True))
                    dropped[np.flatnonzero(long)] = [d in bad for d in map(tuple, digests.tolist())]
                n_lines.append(len(lines))
                n_dropped.append(int(dropped.sum()))
                kept.append("\n".join(x for x, d in zip(lines, dropped.tolist(), strict=True) if not d) if dropped.any() else text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["row", *OUTPUTS])

    return emit


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """Plans made inside trust that a bucket of one file is sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The runs below ``folder``: rows ``(h1, h2, n_docs, holder)``, the holder in one run of a key alone, null elsewhere."""

    SCHEMA = "h1 bigint, h2 bigint, n_docs bigint, holder bigint"

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.at, state = commits.latest(spark, folder)
        self.buckets: int = state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = state.get("levels", [])
        self.batches: list[str] = state.get("batches", [])
        for name in self.names():
            spark.sql(f"create table if not exists {name} ({self.SCHEMA}) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{folder}/{name}'")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The runs that some application has left there."""
        return cls(spark, folder)

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        with _sorted_buckets(self.spark):
            rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _commit(self, levels: list[list[str]], batches: list[str]) -> None:
        gone = set(self.names()) - {name for level in levels for name in level}
        self.at = commits.commit(self.spark, self.folder, self.at, {"buckets": self.buckets, "levels": levels, "batches": batches})
        self.levels, self.batches = levels, batches
        for name in gone:
            self.spark.sql(f"drop table {name}")
            commits.files(self.spark, self.folder).delete(commits.hadoop_path(self.spark, f"{self.folder}/{name}"), True)

    def add(self, batch: str, entries: DataFrame) -> None:
        """Take in the batch named ``batch``, ``entries(doc_id, h1, h2)``. Batches have no ids in common."""
        if batch in self.batches:
            return
        each = entries.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
        own = each.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))
        known = F.lit(False)
        for k, name in enumerate(self.names()):
            own = own.join(self.spark.table(name).select(*KEY, F.lit(True).alias(f"in_{k}")), KEY, "left")
            known = known | F.coalesce(f"in_{k}", F.lit(False))
        # The rows that the merge finds in no run are those of the anti-join; the others only count.
        name = self._write(own.select(*KEY, "n_docs", F.when(~known, F.col("holder")).alias("holder")))
        levels = [[name, *(self.levels[0] if self.levels else [])], *self.levels[1:]]
        self._commit(levels, [*self.batches, batch])
        self.compact()

    def compact(self, whole: bool = False) -> None:
        """Merge two runs of a level into one of the next, and so on; or, if ``whole``, all runs into one."""
        while True:
            names = self.names()
            full = next((k for k, level in enumerate(self.levels) if len(level) > 1), None)
            if full is None and not (whole and len(names) > 1):
                return
            one, two = self.levels[full][:2] if full is not None else names[:2]
            a, b = self.spark.table(one).alias("a"), self.spark.table(two).alias("b")
            both = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in KEY], "full")
            merged = self._write(both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in KEY], (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"), F.coalesce("a.holder", "b.holder").alias("holder")))
            target = max(k for k, level in enumerate(self.levels) if one in level or two in level) + (full is not None)
            levels = [[x for x in level if x not in (one, two)] for level in self.levels] + [[]]
            levels[target].append(merged)
            while levels and not levels[-1]:
                levels.pop()
            self._commit(levels, self.batches)

    def repeated(self, least_docs: int) -> DataFrame:
        """``(h1, h2, n_docs, holder)`` of the keys that so many documents have, from the one run that all are merged into."""
        self.compact(whole=True)
        if not self.names():
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.table(self.names()[0]).filter(F.col("n_docs") >= least_docs)


def _batch_of(docs: DataFrame, batches: int):
    """A batch number for each id, 0 for the largest ones; any limits are right, those of a sketch make batches alike."""
    limits = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1_000)).first()[0] if batches > 1 else []
    number = F.lit(batches - 1)
    for k, limit in enumerate(sorted(set(limits or ()))):
        number = F.when(F.col("doc_id") > limit, batches - 2 - k).otherwise(number)
    return number


def dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """``docs`` without its text, with ``n_lines`` before, ``n_dropped``, and the ``kept`` text."""
    spark = docs.sparkSession
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    texts = texts.select(_batch_of(texts, batches).cast("int").alias("batch"), "doc_id", F.xxhash64("text").alias("digest"), "text")
    entries = materialize(texts.mapInArrow(_entries(least_chars), "batch int, doc_id long, digest long, h1 long, h2 long"), "op11-entries")
    runs = LineRuns(spark, f"{own_dir(spark)}/op11-{uuid.uuid4().hex}")
    for k in range(batches):
        runs.add(str(k), entries.filter(F.col("batch") == k))
    bad = materialize(runs.repeated(least_docs), "op11-repeated")
    # A key may be in a large part of all documents. Rows of one id and text lose the same lines.
    found = hot_join(entries, bad, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    gone = found.groupBy("doc_id", "digest").agg(F.collect_set(F.struct(*KEY)).alias("gone"))
    gone = materialize(gone.select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "gone"), "op11-gone")
    keep = others(docs, text_col, *OUTPUTS)
    packed = pack(docs, keep, doc_id=named(id_col).cast("long"), text=named(text_col)).withColumn("digest", F.xxhash64("text"))
    row = packed.schema["row"].dataType.simpleString()
    joined = packed.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left").select("row", "text", "gone")
    return joined.mapInArrow(_kept(least_chars), f"row {row}, n_lines long, n_dropped long, kept string").select(*unpack(keep), *OUTPUTS)
