"""Operator 7, an exact Jaccard self-join of word-shingle sets with set-relation skipping.

A text's set holds its distinct shingles of five words (its whole word sequence, where it has fewer),
as 64-bit hashes; two texts link when ``100 * |A & B| >= 75 * |A | B|``. The result is each row's
component under links, and no link between different sets is lost to a cap or a sketch:

1. *Equal sets share answers.* Copies fall into one class, which joins as one set.
2. *Index lists.* Shingles have one global order, rare before common, and each set puts only the first
   quarter of its own into lists: similar sets meet in the list of their first common shingle. (The order
   comes from counts of shingles that repeat within a task. Any order is right; this one keeps lists short.)
3. *Block-skipping by position.* An entry knows its position. Pairs are dropped that don't meet at an entry
   which can be their first common one: in the first seventh of the smaller set, with enough behind it for the
   overlap wanted. Lists are cut into blocks by set size, and only blocks that can be similar meet. Of the
   pairs that are left, those go that share fewer list entries than linked sets of their sizes must.
4. *Answers from a similar set.* The best connected set of a list is its hub. First every entry is
   compared with its list's hub only. A set that links to a hub takes over the answers of the hub's
   component: of a list, just the pairs between different components are left, and a list that lies in
   one component is skipped whole. So a group of thousands of near copies costs its number of members,
   not their pairs. For the pairs that are left, too, the hubs stand in (:func:`derived`): a set's *model* is the best
   connected set that it links to, and of all pairs between the sets of two models the models' own overlap is counted, once. By the
   few shingles in which a set differs from its model that overlap gives bounds for each pair, which decide most of them; only
   those that it leaves open are compared themselves.

Counting joins both sets and intersects them in the engine. Sets are rebuilt from the text when they
are asked for, and a bitmap of fixed size tells tasks which ones those are, so neither texts nor all
sets are ever shuffled. Every step between is a stored table.

Null, empty and word-less texts have no shingles, no links and their own ``doc_id`` as component.
Sets are named by 64 bits of their hash. A second, independent hash is stored beside each name, and where sets
of one name differ in it, they are renamed by it, so sets are told apart by 128 bits.

Null and empty texts have an empty set, link to nothing and keep their own id. Rows with equal ``doc_id`` but
different texts are different sets. Null ids stay null unless linked to others (the smallest known id names a
component). Repeated rows get a row each. Texts are shingled whole: a task holds one text's shingles at a time
beside a block of short texts. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldpulse.llm.components import components
from worldpulse.llm.shared import hot_join, let_go, materialize, named, pack, unpack
from worldpulse.llm.shingles import shingle_sets

BLOCK_BYTES = 1_000_000
HELD_SHINGLES = 2_000_000
COMMON_LEAST = 4
#: A shingle repeated this often has a long list, whose entries are dealt by set instead of by shingle.
LONG_LIST = 10_000
MAX_COMMON = 2_000_000
#: Bits of the bitmap of sets that are asked for: 16 for each, between these bounds. A full one costs time, not links.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
NO_ID = -(1 << 63)


def _blocks(batches: Iterator[pa.RecordBatch], *more: int) -> Iterator[tuple]:
    """Ids, shingle sets and the columns ``more``, about a MB of text at a time."""
    let_go()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        begin = size = 0
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for k, n in enumerate(lengths):
            size += n
            if size >= BLOCK_BYTES or k + 1 == len(lengths):
                yield ids[begin : k + 1], shingle_sets(texts.slice(begin, k + 1 - begin).to_pylist()), *[batch.column(c).slice(begin, k + 1 - begin).to_pylist() for c in more]
                begin, size = k + 1, 0


def _hash(s: np.ndarray, seed: int) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes(), seed), np.uint64).astype(np.int64))


def _identity(s: np.ndarray, shared: frozenset[int] = frozenset()) -> int | None:
    """A set's own 64-bit name: its hash, or its second one where different sets share the first."""
    if not len(s):
        return None
    name = _hash(s, 0)
    return _hash(s, 1) if name in shared else name


PROFILE = "row string, doc_id long, n long, v long, w long, h long, c long"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row its place and id, its set's size, name and second hash; and, of the task's distinct sets, the shingles that repeat, with their counts."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def repeated() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        h, c = h[c > 1].view(np.int64), c[c > 1]
        none = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.string()), none, none, none, none, pa.array(h), pa.array(c)], names=["row", "doc_id", "n", "v", "w", "h", "c"])

    for ids, sets, rows in _blocks(batches, 2):
        names = [_identity(s) for s in sets]
        second = [_hash(s, 1) if len(s) else None for s in sets]
        for v, s in zip(names, sets, strict=True):
            if v is not None and v not in seen:
                seen.add(v)
                held.append(s)
                size += len(s)
        none = pa.nulls(len(ids), pa.int64())
        columns = [ids, [len(s) for s in sets], names, second]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), *[pa.array(c, pa.int64()) for c in columns], none, none], names=["row", "doc_id", "n", "v", "w", "h", "c"])
        if size >= HELD_SHINGLES:
            yield repeated()
            held, size = [], 0
    yield repeated()


def _postings(common: np.ndarray, counts: np.ndarray, shared: frozenset[int], long_list: int) -> Callable:
    long = common[counts >= long_list]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _blocks(batches):
            shingles, names, sizes, places = [], [], [], []
            for s in sets:
                v = _identity(s, shared)
                if v is None or v in seen:
                    continue
                seen.add(v)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    met = common[at] == s
                    if met.any():
                        s = s[np.argsort(np.where(met, counts[at], 0), kind="stable")]
                k = len(s) // 4 + 1
                shingles.append(s[:k])
                names.append(v)
                sizes.append(len(s))
                places.append(np.arange(k, dtype=np.int32))
            if names:
                k = [len(x) for x in shingles]
                h, v = np.concatenate(shingles), np.repeat(names, k)
                part = pa.array(v, mask=~np.isin(h, long))
                yield pa.RecordBatch.from_arrays([h.view(np.int64), v, np.repeat(np.array(sizes, np.int32), k), np.concatenate(places), part], names=["h", "v", "n", "pos", "part"])

    return emit


def _asked(bitmap: np.ndarray, shared: frozenset[int]) -> Callable:
    bits = 8 * len(bitmap)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for ids, sets in _blocks(batches):
            found = []
            for doc_id, s in zip(ids, sets, strict=True):
                v = _identity(s, shared)
                if v is None or v in seen:
                    continue
                bit = (v ^ (NO_ID if doc_id is None else doc_id)) % bits
                if bitmap[bit >> 3] >> (bit & 7) & 1:
                    seen.add(v)
                    found.append((v, s.view(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], names=["v", "s"])

    return emit


def common_shingles(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``MAX_COMMON`` of the most repeated shingles, sorted, with their counts."""
    counted = profile.filter("h is not null").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= COMMON_LEAST)
    levels = sorted(((r["level"], r["n"]) for r in counted.groupBy(F.floor(F.log2("c")).alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 62, 0
    for level, n in levels:
        total += n
        if total > MAX_COMMON:
            break
        least = level
    rows = counted.filter(F.col("c") >= 2**least).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["c"].to_numpy(np.int64)[order]


def _met(left: DataFrame, right: DataFrame, on: list[str], more: Column) -> DataFrame:
    """Distinct pairs (a, b) with a < b of entries that meet in a list, with their sizes ``na`` and ``nb``.

    Sizes must be similar, and the entry able to be the first common one: early enough in the smaller set,
    and with enough of both sets to follow.
    """
    n1, p1, v1, n2, p2, v2 = (F.col(f"{x}.{y}") for x in "xy" for y in ("n", "pos", "v"))
    similar = (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (v1 != v2)
    # An overlap of 3 / 7 of both sizes is a similarity of 3 / 4.
    first_is_small = (n1 < n2) | ((n1 == n2) & (v1 < v2))
    early = F.when(first_is_small, 7 * p1 <= n1).otherwise(7 * p2 <= n2)
    enough = 7 * F.least(n1 - p1, n2 - p2) >= 3 * (n1 + n2)
    one, two = F.struct(v1.alias("v"), n1.alias("n")), F.struct(v2.alias("v"), n2.alias("n"))
    met = left.alias("x").join(right.alias("y"), [*[F.col(f"x.{c}") == F.col(f"y.{c}") for c in on], similar & early & enough & more])
    pairs = met.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
    return pairs.select(F.col("a.v").alias("a"), F.col("b.v").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))


def _likely(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs that share as many list entries as linked sets must.

    Of a set's first quarter no more entries are missing from the other set than the sizes leave beyond the
    overlap; the rest are the first common ones in the order, hence in the first quarter of either set.
    ``heads(v, head)`` holds each set's list entries.
    """
    overlap = F.ceil(3 * (F.col("na") + F.col("nb")) / 7)
    least = F.least(*[F.floor(F.col(n) / 4) + 1 - (F.col(n) - overlap) for n in ("na", "nb")])
    half = pairs.withColumnRenamed("a", "v").join(heads, "v").withColumnsRenamed({"v": "a", "head": "one"})
    both = half.withColumnRenamed("b", "v").join(heads, "v").withColumnRenamed("v", "b")
    return both.filter(F.size(F.array_intersect("one", "head")) >= least).select("a", "b", "na", "nb")


def _size_block(n: Column) -> Column:
    """Sets of a similarity of 3 / 4 are at most one block apart."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")


def _linked(overlap: Column) -> Column:
    """Whether sets of ``na`` and ``nb`` shingles with this overlap have a similarity of 3 / 4."""
    return 7 * overlap >= 3 * (F.col("na") + F.col("nb"))


def overlaps(docs: DataFrame, pairs: DataFrame, least: DataFrame, shared_names: frozenset[int], links: bool) -> DataFrame:
    """``(a, b, na, nb, overlap)`` of the stored ``pairs``, counted shingle by shingle; with ``links`` of those that link. ``least``: the ``doc_id`` that stands for each set."""
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "op7-asked")
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * asked.count()).bit_length()))
    bits = asked.join(least, "v").select(F.pmod(F.col("v").bitwiseXOR(F.col("least")), F.lit(size)).alias("bit"))
    bucket, place = F.floor(F.col("bit") / 32_768), F.col("bit") % 32_768
    bitmap = np.zeros(size // 8, np.uint8)
    # Rows come a partition at a time, a job each; eight partitions bound what is under way to an eighth of the bitmap.
    for r in bits.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits")).coalesce(8).toLocalIterator():
        bitmap[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    # A set can come twice, by a repeated row or a chance bit; that repeats a link, which the last step undoes.
    sets = materialize(docs.mapInArrow(lambda batches: _asked(shared.value, shared_names)(batches), "v long, s array<long>"), "op7-sets")
    half = pairs.select(F.col("a").alias("v"), "b").join(sets, "v").select(F.col("v").alias("a"), F.col("b").alias("v"), F.col("s").alias("sa"))
    counted = half.join(sets, "v").select("a", F.col("v").alias("b"), F.size("sa").alias("na"), F.size("s").alias("nb"), F.size(F.array_intersect("sa", "s")).alias("overlap"))
    return materialize((counted.filter(_linked(F.col("overlap"))) if links else counted).distinct(), "op7-links")


def models(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(v, model, plus, minus)`` of the ``wanted`` sets: the best connected set that each links to, and the numbers of shingles
    that it has beyond that one and lacks of it. A set without links is its own model."""
    one = links.select(F.col("a").alias("v"), F.col("b").alias("model"), (F.col("na") - F.col("overlap")).alias("plus"), (F.col("nb") - F.col("overlap")).alias("minus"))
    two = links.select(F.col("b").alias("v"), F.col("a").alias("model"), (F.col("nb") - F.col("overlap")).alias("plus"), (F.col("na") - F.col("overlap")).alias("minus"))
    ways = one.unionByName(two)
    degree = materialize(ways.groupBy("model").agg(F.count("*").alias("degree")), "op7-degrees")
    # A hub may have a large part of all links.
    ranked = hot_join(materialize(ways.join(wanted, "v", "left_semi"), "op7-ways"), degree, "model")
    best = ranked.groupBy("v").agg(F.max_by(F.struct("model", "plus", "minus"), F.struct("degree", "model")).alias("best"))
    none = F.lit(0)
    return wanted.join(best, "v", "left").select("v", F.coalesce("best.model", "v").alias("model"), F.coalesce("best.plus", none).alias("plus"), F.coalesce("best.minus", none).alias("minus"))


def with_models(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """``pairs(a, b, na, nb)`` with ``low`` and ``high``, the two models in order, and ``plus`` and ``minus`` of both sets together."""
    half = pairs.join(of.select(F.col("v").alias("a"), F.col("model").alias("ma"), F.col("plus").alias("pa"), F.col("minus").alias("qa")), "a")
    both = half.join(of.select(F.col("v").alias("b"), F.col("model").alias("mb"), F.col("plus").alias("pb"), F.col("minus").alias("qb")), "b")
    return both.select("a", "b", "na", "nb", F.least("ma", "mb").alias("low"), F.greatest("ma", "mb").alias("high"), (F.col("pa") + F.col("pb")).alias("plus"), (F.col("qa") + F.col("qb")).alias("minus"))


def judged(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of :func:`with_models` with ``verdict``: true or false where the overlap of their models, ``known(low, high, overlap)``,
    decides whether they link, else null. An overlap can grow by what the sets have beyond their models and shrink by what they lack."""
    found = pairs.join(known, ["low", "high"], "left")
    most = F.least(F.col("overlap") + F.col("plus"), F.col("na"), F.col("nb"))
    verdict = F.when(_linked(F.col("overlap") - F.col("minus")), True).when(~_linked(most), False)
    return found.select("a", "b", "na", "nb", verdict.alias("verdict"))


def derived(docs: DataFrame, pairs: DataFrame, star_links: DataFrame, least: DataFrame, shared_names: frozenset[int]) -> DataFrame:
    """``(a, b)`` of the stored ``pairs(a, b, na, nb)`` that link, by the overlaps of their models as far as these decide."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "op7-wanted")
    placed_pairs = materialize(with_models(pairs, materialize(models(star_links, wanted), "op7-models")), "op7-modelled")
    between = materialize(placed_pairs.filter("low != high").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct(), "op7-between")
    known = overlaps(docs, between, least, shared_names, links=False).select(F.col("a").alias("low"), F.col("b").alias("high"), "overlap")
    told = materialize(judged(placed_pairs, known), "op7-judged")
    links = told.filter("verdict").select("a", "b")
    left_open = told.filter("verdict is null").select("a", "b")
    if left_open.limit(1).count():
        links = links.unionByName(overlaps(docs, left_open, least, shared_names, links=True).select("a", "b"))
    return links


def place(docs: DataFrame) -> Column:
    """The file that holds a row of the stored table ``docs``, and its number there: the same in every scan, however it is split among tasks."""
    at = docs.metadataColumn("_metadata")
    return F.concat_ws("#", at.getField("file_path"), F.lpad(at.getField("row_index").cast("string"), 19, "0"))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST, row: Column | None = None) -> DataFrame:
    """``(row, doc_id, n_shingles, component, component_id)`` for every row of ``docs``.

    ``row`` is the string by which the caller knows a row, null where none is given; ``component`` is the name of the
    component's least set, null for a row without words.
    """
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    numbered = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"), (F.lit(None).cast("string") if row is None else row).alias("row"))
    profile = materialize(numbered.mapInArrow(_profile, PROFILE), "op7-profile")
    rows = profile.filter("h is null").select("row", "doc_id", "n", "v", "w")
    least = rows.filter("v is not null").groupBy("v").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("least"), F.min("w").alias("low"), F.max("w").alias("high"))
    least = materialize(least, "op7-names")
    # Different sets of one 64-bit name: some 2**-65 of the pairs of sets, so a handful at any size.
    shared_names = frozenset(r["v"] for r in least.filter("low < high").collect())
    if shared_names:
        rows = rows.withColumn("v", F.when(F.col("v").isin(list(shared_names)), F.col("w")).otherwise(F.col("v")))
        least = rows.filter("v is not null").groupBy("v").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("least"))
    least = least.select("v", "least")
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(profile))

    # Lists with entries of two sets or more; copies of an entry come from different tasks. Long lists are known
    # to have them, so each of their entries is a part of its own (``part`` is the set), and no task gets them whole.
    postings = texts.mapInArrow(lambda batches: _postings(*common.value, shared_names, long_list)(batches), "h long, v long, n int, pos int, part long")
    of_list = Window.partitionBy("h", "part")
    lists = postings.select("*", F.min("v").over(of_list).alias("low"), F.max("v").over(of_list).alias("high"))
    lists = lists.filter("part is not null or low < high").dropDuplicates(["h", "part", "v"])
    lists = materialize(lists.select("h", "v", "n", "pos"), "op7-lists")

    degree = lists.groupBy("v").agg(F.count("*").alias("degree"))
    # Joins of lists with a stored row per list: two plain exchanges, of which adaptive execution can split a long list's.
    hubs = lists.join(degree, "v").groupBy("h").agg(F.max_by(F.struct("v", "n", "pos"), F.struct("degree", "v")).alias("hub"))
    hubs = materialize(hubs.select("h", "hub.*"), "op7-hubs")
    heads = materialize(lists.groupBy("v").agg(F.collect_list("h").alias("head")), "op7-heads")
    starred = materialize(_likely(_met(lists, hubs, ["h"], F.lit(True)), heads), "op7-stars")
    star_links = overlaps(texts, starred, least, shared_names, links=True)

    # What the hubs' answers leave open: pairs of different components, from lists that have two or more.
    of = components(star_links)
    spread = materialize(lists.join(of, "v", "left").select("h", "v", "n", "pos", F.coalesce("component", "v").alias("k")), "op7-placed")
    parts = spread.groupBy("h", "k").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("h").agg(F.count("*").alias("parts"), F.max_by("k", F.struct("size", "k")).alias("main")).filter("parts > 1").drop("parts")
    mixed = materialize(mixed, "op7-mixed")
    mixed = spread.join(mixed, "h").withColumn("block", _size_block(F.col("n")))
    probes = mixed.filter("k != main").withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    once = (F.col("x.k") != F.col("y.k")) & ((F.col("y.k") == F.col("y.main")) | (F.col("x.v") < F.col("y.v")))
    rest = _likely(_met(probes, mixed, ["h", "block"], once), heads)
    rest = materialize(rest.join(starred, ["a", "b"], "left_anti"), "op7-rest")
    links = star_links.select("a", "b")
    if rest.limit(1).count():
        links = links.unionByName(derived(texts, rest, star_links, least, shared_names))

    # A component is named by its rows' smallest id. Only linked sets need one, and a component may hold a large part of them.
    linked = materialize(components(links).join(least, "v"), "op7-linked")
    known = F.when(F.col("least") != NO_ID, F.col("least"))
    names = materialize(linked.groupBy("component").agg(F.min(known).alias("component_id")), "op7-components")
    final = hot_join(linked, names, "component").select("v", "component", "component_id", F.lit(True).alias("linked"))
    alone = F.when(F.col("least") != NO_ID, F.col("least"))
    named_sets = least.join(final, "v", "left").select("v", F.coalesce("component", "v").alias("component"), F.when(F.col("linked"), F.col("component_id")).otherwise(alone).alias("component_id"))
    # Copies may be a large part of all rows.
    found = hot_join(rows.filter("v is not null"), materialize(named_sets, "op7-sets-named"), "v")
    found = found.select("row", "doc_id", "n", "component", "component_id").unionByName(rows.filter("v is null").select("row", "doc_id", "n", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("component_id")))
    return found.select("row", "doc_id", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``."""
    return placed(docs, id_col, text_col, long_list).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one of the smallest ``doc_id``, then the first.

    ``docs`` is a stored table; any other is stored first, since rows are found again by their place in its files. Rows of different components all stay, whatever their ids, and so do rows without words. A null id counts as
    larger than any other, so a copy without an id goes where its original is known.
    """
    try:
        row = place(docs)
    except AnalysisException:
        docs = materialize(docs, "op7-docs")
        row = place(docs)
    found = materialize(placed(docs, row=row), "op7-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    kept = found.filter("component is not null").groupBy("component").agg(first.alias("first")).select("first.row")
    kept = kept.unionByName(found.filter("component is null").select("row"))
    packed = pack(docs, docs.columns, at=row)
    return packed.join(kept.withColumnRenamed("row", "at"), "at", "left_semi").select(*unpack(docs.columns))
