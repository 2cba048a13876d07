"""Operator 9, sharding by histogram sort, in DataFrame functions only.

Rows are ordered by (group key, row key), both 64-bit. To cut that order into shards of near equal
bytes without sorting first, rounds of exact histograms look for the splitters: the first counts
bytes per leading bits of the group key, and each next one looks only into the cells that hold a
wanted boundary, with ``BITS`` more bits as probes. Counting is a partial sum in every task plus at
most ``(shards - 1) * 2**BITS`` cells, whatever the input's size. A splitter is settled once a cell
border is within ``tolerance`` of a shard's share, or once the open cells hold so few rows
(``EXACT_ROWS``) that their keys are read themselves. In a group that is too heavy for either, the
search goes on over the row key: a hot group is split, and others stay whole where a border between
groups is within tolerance or as near as one between rows. Then rows are exchanged once. A shard of many rows is
dealt in parts of about ``rows_per_task`` rows, cut at leading bits of the group key, and of the row key inside a
hot group; each part is sorted and numbered by a task of its own, from the sizes of the parts before it on.

An empty table gives no rows. Null sizes count 0. Rows equal in both keys stay together, in an
order fixed by the order columns; a splitter beside them takes the nearest border. Only keys and sizes are looked at,
so very long texts in other columns don't matter. Extra columns pass through under any name; one named ``shard`` or
``slot`` is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldpulse.llm.shared import named, others, pack, small_table, unpack

BITS = 10
TOLERANCE = 0.005
#: Cells with no more rows than this in all are settled from their rows' keys.
EXACT_ROWS = 20_000
#: Rows of a part, about, and the most leading bits that parts are cut at (their number must suit an exchange).
ROWS_PER_TASK, MOST_BITS = 2_000_000, 15


Bound = tuple[int, int | None]


def _exact(keys: DataFrame, where: Column, cells: dict[int, tuple[int, list[float]]], cell_of, tolerance: float) -> dict[float, Bound]:
    """Settle targets from the rows of their cells themselves, which are at most ``EXACT_ROWS``."""
    rows = keys.filter(where).groupBy("group_key", "row_key").agg(F.sum("size").alias("size")).orderBy("group_key", "row_key").collect()
    found: dict[float, Bound] = {}
    for cell, (below, targets) in cells.items():
        own = [r for r in rows if cell_of(r) == cell]
        groups: list[tuple[int, Bound]] = []
        borders: list[tuple[int, Bound]] = []
        for k, r in enumerate(own):
            borders.append((below, (r["group_key"], r["row_key"])))
            if not k or own[k - 1]["group_key"] != r["group_key"]:
                groups.append((below, (r["group_key"], None)))
            below += r["size"]
        end = (own[-1]["group_key"], own[-1]["row_key"] + 1)
        for target in targets:
            near = [min([*x, (below, end)], key=lambda b: abs(b[0] - target)) for x in (groups, borders)]
            found[target] = near[0][1] if abs(near[0][0] - target) <= max(tolerance, abs(near[1][0] - target)) else near[1][1]
    return found


def _refine(keys: DataFrame, column: str, group: int | None, below: int, targets: list[float], tolerance: float) -> dict[float, Bound]:
    """Histogram rounds over one 64-bit column: all rows by group key, or the rows of one group by row key."""
    inside = F.lit(True) if group is None else F.col("group_key") == group
    bound = (lambda k: (k, None)) if group is None else (lambda k: (group, k))
    found: dict[float, Bound] = {}
    open_cells: dict = {None: (below, targets)}
    shift = 64
    while open_cells:
        before, shift = shift, max(0, shift - BITS)
        where = inside if None in open_cells else inside & F.shiftright(column, before).isin(list(open_cells))
        cell = F.shiftright(column, shift).alias("cell")
        counts = keys.filter(where).groupBy(cell).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        of = {r["cell"]: r for r in counts}
        following: dict = {}
        for outer, (under, wanted) in open_cells.items():
            at = sorted(c for c in of if outer is None or c >> (before - shift) == outer)
            k = 0
            for target in wanted:
                while k < len(at) - 1 and under + of[at[k]]["bytes"] < target:
                    under += of[at[k]]["bytes"]
                    k += 1
                low, high = target - under, under + of[at[k]]["bytes"] - target
                if min(low, high) <= tolerance:
                    found[target] = bound((at[k] + (high < low)) << shift)
                else:
                    following.setdefault(at[k], (under, []))[1].append(target)
        open_cells = following
        single = {c: x for c, x in open_cells.items() if of[c]["low"] == of[c]["high"] and of[c]["rows"] > EXACT_ROWS}
        for c, (under, wanted) in single.items():
            if group is None:
                found |= _refine(keys, "row_key", of[c]["low"], under, wanted, tolerance)
            else:
                end = under + of[c]["bytes"]
                found |= {t: bound(of[c]["low"] + (end - t < t - under)) for t in wanted}
            del open_cells[c]
        if open_cells and sum(of[c]["rows"] for c in open_cells) <= EXACT_ROWS:
            return found | _exact(keys, inside & F.shiftright(column, shift).isin(list(open_cells)), open_cells, lambda r: r[column] >> shift, tolerance)
    return found


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[Bound]:
    """The ``shards - 1`` least keys of shards 1 and up, over columns ``group_key``, ``row_key`` and ``size``; a None row key is below all."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    share = total / shards
    targets = [share * k for k in range(1, shards)]
    found = _refine(keys, "group_key", None, 0, targets, tolerance * share)
    return [found[t] for t in targets]


def _reaches(bound: tuple[int, int | None]) -> Column:
    group, row = bound
    if group > 2**63 - 1:
        return F.lit(False)
    past = F.col("group_key") >= F.lit(group)
    if row is None:
        return past
    inside = F.lit(False) if row > 2**63 - 1 else F.col("row_key") >= F.lit(row)
    return (F.col("group_key") > F.lit(group)) | ((F.col("group_key") == F.lit(group)) & inside)


def _bits(rows: int, rows_per_task: int) -> int:
    return min(MOST_BITS, max(0, (-(-rows // rows_per_task) - 1).bit_length()))


def _leading(column: str, bits: Column | int) -> Column:
    """The leading bits of a long, as a number from 0 that keeps its order."""
    if isinstance(bits, int):
        return F.lit(0).cast("long") if not bits else F.shiftright(column, 64 - bits) + F.lit(1 << (bits - 1))
    moved = F.call_function("shiftright", F.col(column), 64 - F.greatest(bits, F.lit(1))) + F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(bits, F.lit(1)) - 1)
    return F.when(bits > 0, moved).otherwise(F.lit(0).cast("long"))


def _parts(placed: DataFrame, shards: int, rows_per_task: int) -> tuple[DataFrame, int]:
    """``placed`` with ``part``, which ascends with the keys and has rows of one shard only, and how many parts there may be."""
    bits = _bits(placed.count(), rows_per_task)
    cell = _leading("group_key", bits)
    cells = {r["cell"]: r["n"] for r in placed.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    # Only a hot group can make a cell heavy. There are fewer of them than parts.
    heavy = [c for c, n in cells.items() if n > 2 * rows_per_task]
    hot: dict[int, list[tuple[int, int]]] = {}
    if heavy:
        inside = placed.join(F.broadcast(small_table(placed.sparkSession, [(c,) for c in heavy], "cell long")), cell == F.col("cell"))
        for r in inside.groupBy("cell", "group_key").agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_task).orderBy("group_key").collect():
            hot.setdefault(r["cell"], []).append((r["group_key"], _bits(r["n"], rows_per_task)))
    table, base = [], 0
    for c in sorted(cells):
        table.append((c, base, hot.get(c, [])))
        base += 1 + sum(1 + (1 << b) for _, b in hot.get(c, []))
    of = small_table(placed.sparkSession, table, "cell long, base long, hot array<struct<g:long,bits:int>>")
    joined = placed.withColumn("cell", cell).join(F.broadcast(of), "cell")

    def passed(n: Column, h: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), h["bits"])
        return n + F.when(F.col("group_key") > h["g"], 1 + size).when(F.col("group_key") == h["g"], 1 + _leading("row_key", h["bits"])).otherwise(F.lit(0).cast("long"))

    # Cells and shards both ascend with the keys, so their sum changes wherever one of them does.
    part = F.col("base") + F.aggregate("hot", F.lit(0).cast("long"), passed) + F.col("shard")
    return joined.withColumn("part", part.cast("int")).drop("cell", "base", "hot"), base + shards


def shard(rows: DataFrame, shards: int, order: list[str], tolerance: float = TOLERANCE, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``rows`` has the long columns ``group_key``, ``row_key`` and ``size`` and is scanned once per round;
    pass a stored table, not a costly plan. ``order`` breaks ties of both keys.
    """
    keep = others(rows, "shard", "slot")
    tie = F.struct(*[named(c) for c in order]) if order else F.struct(F.lit(0))
    sized = pack(rows, keep, group_key=F.col("group_key"), row_key=F.col("row_key"), size=F.coalesce("size", F.lit(0)), tie=tie)
    number = F.lit(0)
    for bound in splitters(sized.select("group_key", "row_key", "size"), shards, tolerance):
        number = number + F.when(_reaches(bound), 1).otherwise(0)
    placed, most = _parts(sized.withColumn("shard", number.cast("int")), shards, rows_per_task)
    starts, last, below = [], None, 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.min("shard").alias("shard")).orderBy("part").collect():
        last, below = (r["shard"], 0) if r["shard"] != last else (last, below)
        starts.append((r["part"], below))
        below += r["n"]
    start = F.broadcast(small_table(rows.sparkSession, starts, "part int, start long"))
    dealt = placed.repartitionById(max(1, most), F.col("part"))
    inside = Window.partitionBy("part").orderBy("group_key", "row_key", "tie")
    ranked = dealt.withColumn("slot", F.row_number().over(inside).cast("long") - 1)
    own = [F.col("size").alias(c) if c.lower() == "size" else x for c, x in zip(keep, unpack(keep), strict=True)]
    return ranked.join(start, "part").select(*own, "shard", (F.col("slot") + F.col("start")).alias("slot"))
