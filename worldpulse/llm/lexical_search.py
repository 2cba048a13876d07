"""Operator 13, ranked lexical search: an index of shards, each searched by MaxScore.

Terms are the longest stretches of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.
With N documents that have a term, L their terms, n a document's terms, df a term's documents and tf its occurrences, a term
weighs ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``, a document has ``m = 50 + (50 n N) div L``, and its score is the sum of
``w * ((1000000000 tf) div (1000 tf + 20 m))`` over the query's distinct terms, in 64-bit integers.

:func:`build` cuts the documents into shards of bounded text as a task reads them and stores each shard's postings: per term
the shard's documents and occurrences, with the most occurrences and the least document length among them. No row leaves
its task for that. :func:`search` takes queries in blocks of bounded size, reads the postings of their terms alone and brings
each shard's together. In a shard, a query's terms are tried by upper bound, which the two stored numbers give:

- *Essential* lists are added up whole, as long as a document that is in none of them could still be among the best.
- Then the others are *probed*: looked up for those documents alone that can still qualify, in turns, until none is left.

The threshold is the k-th best score that the task has seen in any shard, so later shards skip more. Each task hands on its
k best of each query, and these are merged by rank. Equal scores go by ascending ``doc_id``, rows without one last.

Null and empty texts have no terms: they are in no list and count in neither N nor L; queries without terms find nothing.
Repeated rows are rows of their own, and queries too. A very long text makes a shard of its own. An empty table, of either
kind, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worldpulse.llm.shared import let_go, materialize, named

SHARD_BYTES = 8_000_000
#: Bytes of query text that are sent to every task at a time.
BLOCK_BYTES = 4_000_000
#: Lower-cases A-Z and makes the other ASCII characters that no term has one separator.
_TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

INDEX = "shard long, term binary, df int, docs array<int>, tfs array<int>, most int, least int, ids array<long>, sizes array<int>"
FOUND = "query long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split() if text else []


def _shard(number: int, ids: list[int | None], sizes: list[int], words: list[bytes], numbers: list[np.ndarray]) -> pa.RecordBatch:
    """A row of documents, then a row for each term."""
    docs = np.repeat(np.arange(len(sizes)), sizes)
    code, tf = np.unique(np.concatenate([*numbers, np.zeros(0, np.int64)]) * len(sizes) + docs, return_counts=True)
    term, doc = code // max(1, len(sizes)), code % max(1, len(sizes))
    begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(tf, begin) if len(begin) else begin
    least = np.minimum.reduceat(np.array(sizes)[doc], begin) if len(begin) else begin
    k = len(begin)
    offsets = np.concatenate([[0, 0], begin[1:], [len(term)]] if k else [[0, 0]]).astype(np.int32)
    documents = np.array([0, len(sizes), *[len(sizes)] * k], np.int32)
    none = pa.nulls(1, pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(k + 1, number)),
            pa.array([None, *[words[t] for t in term[begin].tolist()]], pa.binary()),
            pa.array([None, *np.diff([*begin.tolist(), len(term)]).tolist()], pa.int32()),
            pa.ListArray.from_arrays(offsets, doc.astype(np.int32)),
            pa.ListArray.from_arrays(offsets, tf.astype(np.int32)),
            pa.concat_arrays([none, pa.array(most.astype(np.int32))]),
            pa.concat_arrays([none, pa.array(least.astype(np.int32))]),
            pa.ListArray.from_arrays(documents, pa.array(ids, pa.int64())),
            pa.ListArray.from_arrays(documents, pa.array(sizes, pa.int32())),
        ],
        names=["shard", "term", "df", "docs", "tfs", "most", "least", "ids", "sizes"],
    )


def _shards(limit: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        number = TaskContext.get().partitionId() << 32
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        ids, sizes, numbers, size = [], [], [], 0
        for batch in batches:
            texts = batch.column("text")
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = terms(texts[k].as_py())
                if own:
                    ids.append(doc_id)
                    sizes.append(len(own))
                    numbers.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
                    size += sum(map(len, own)) + len(own)
                if size >= limit:
                    yield _shard(number, ids, sizes, list(known), numbers)
                    number += 1
                    known.clear()
                    ids, sizes, numbers, size = [], [], [], 0
        if ids:
            yield _shard(number, ids, sizes, list(known), numbers)

    return emit


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored index of all rows of ``docs``: per shard a row of documents (without a term) and a row per term."""
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return materialize(texts.mapInArrow(_shards(shard_bytes), INDEX), "op13-index")


class Best:
    """The ``k`` best documents of one query so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores = np.zeros(0, np.int64)
        self.order = np.zeros(0, np.int64)
        self.unknown = np.zeros(0, bool)

    def threshold(self) -> int:
        """The least score that is worth a look; equal ones may win by their id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        scores, ids, unknown = np.concatenate([self.scores, scores]), np.concatenate([self.order, ids]), np.concatenate([self.unknown, unknown])
        first = np.lexsort((ids, unknown, -scores))[: self.k]
        self.scores, self.order, self.unknown = scores[first], ids[first], unknown[first]


def search_shard(postings: list[tuple[int, int, np.ndarray, np.ndarray]], m: np.ndarray, ids: np.ndarray, unknown: np.ndarray, best: Best) -> int:
    """Let ``best`` take the documents of one shard; how many postings were read.

    ``postings``: the query's terms here as (upper bound, weight, documents, occurrences). ``m``: the documents' lengths as
    the score has them.
    """
    lists = sorted((p for p in postings if p[0]), key=lambda p: -p[0])
    rest = sum(p[0] for p in lists)
    scores = np.zeros(len(m), np.int64)
    read, least = 0, best.threshold()
    at = 0
    # Essential: a document in none of the lists so far can still reach the threshold by the rest.
    while at < len(lists) and rest >= least:
        bound, weight, docs, tfs = lists[at]
        scores[docs] += weight * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[docs]))
        read += len(docs)
        rest -= bound
        at += 1
        if len(scores) >= best.k:
            least = max(least, int(np.partition(scores, len(scores) - best.k)[len(scores) - best.k]))
    able = np.flatnonzero((scores > 0) & (scores + rest >= least))
    # The others: only for documents that can still qualify.
    for bound, weight, docs, tfs in lists[at:]:
        if not len(able):
            break
        there = np.minimum(np.searchsorted(docs, able), len(docs) - 1)
        held = docs[there] == able
        met, tf = able[held], tfs[there[held]]
        scores[met] += weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[met]))
        read += len(able)
        rest -= bound
        if len(able) >= best.k:
            own = scores[able]
            least = max(least, int(np.partition(own, len(own) - best.k)[len(own) - best.k]))
        able = able[scores[able] + rest >= least]
    best.add(scores[able], ids[able], unknown[able])
    return read


def _searched(queries: list[list[bytes]], weights: dict[bytes, int], n_docs: int, n_terms: int, k: int):
    """Shards come in their order, each one's documents first."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        found = [Best(k) for _ in queries]
        shard = None
        lists: dict[bytes, tuple[int, int, np.ndarray, np.ndarray]] = {}
        m = ids = unknown = None

        def run() -> None:
            for own, best in zip(queries, found, strict=True):
                mine = [lists[t] for t in own if t in lists]
                if mine:
                    search_shard(mine, m, ids, unknown, best)

        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "term", "docs", "tfs", "most", "least", "ids", "sizes")]
            for at, (number, term, most, short) in enumerate(zip(*[columns[c].to_pylist() for c in (0, 1, 4, 5)], strict=True)):
                if number != shard:
                    if lists:
                        run()
                    shard, lists = number, {}
                if term is None:
                    m = 50 + (50 * n_docs * columns[7][at].values.to_numpy().astype(np.int64)) // n_terms
                    own = columns[6][at].values
                    unknown = own.is_null().to_numpy(zero_copy_only=False)
                    ids = own.fill_null(0).to_numpy()
                elif (weight := weights.get(term, 0)) > 0:
                    bound = weight * ((1_000_000_000 * most) // (1000 * most + 20 * (50 + (50 * n_docs * short) // n_terms)))
                    lists[term] = (bound, weight, columns[2][at].values.to_numpy().astype(np.int64), columns[3][at].values.to_numpy().astype(np.int64))
        if lists:
            run()
        for number, best in enumerate(found):
            if len(best.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.scores), number)), pa.array(best.order, mask=best.unknown), pa.array(best.scores)], names=["query", "doc_id", "score"])

    return emit


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(query, rank, doc_id, score)``: the ``k`` best documents of each query, under its ``id_col``'s name in place of ``query``."""
    spark = index.sparkSession
    asked = materialize(queries.select(named(id_col).alias("id"), named(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "op13-queries")
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    counted = index.filter("term is null").agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_docs, n_terms = counted[0] or 0, counted[1] or 0
    blocks = -(-size // block_bytes)
    out = None
    for block in range(blocks if n_docs else 0):
        rows = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).collect() if blocks > 1 else asked.collect()
        own = [sorted(set(terms(r["text"]))) for r in rows]
        wanted = sorted(set().union(*own)) if own else []
        if not wanted:
            continue
        words = spark.createDataFrame(pa.table({"term": pa.array(wanted, pa.binary())}))
        # The block bounds the words; the lists that they name are read once for the weights and once for the search.
        lists = index.join(F.broadcast(words), "term", "left_semi")
        df = {bytes(r["term"]): r["df"] for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        together = lists.unionByName(index.filter("term is null")).select("shard", "term", "docs", "tfs", "most", "least", "ids", "sizes")
        by_shard = together.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        found = by_shard.mapInArrow(_searched(own, weights, n_docs, n_terms, k), FOUND)
        # Of each task's best the overall ones: at most tasks x queries x k rows.
        ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], f"query long, id {asked.schema['id'].dataType.simpleString()}")
        found = materialize(found, "op13-found").join(F.broadcast(ids), "query")
        found = found.select((F.col("query") + (block << 32)).alias("query"), "id", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"query long, id {asked.schema['id'].dataType.simpleString()}, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("id").alias(id_col), "rank", "doc_id", "score")
