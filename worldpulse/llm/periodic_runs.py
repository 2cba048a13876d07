"""Operator 12, periodic runs of words by Stoye and Gusfield's traversal of a suffix tree.

A run is a longest stretch of words with a smallest period ``q``: words ``q`` apart are identical. Wanted are the runs
of at least ``exponent`` periods (a whole number) and ``least`` words. Per text:

1. *Suffix tree.* Suffixes are sorted by doubling, which also gives the lengths of common prefixes of neighbours; the
   intervals between smaller lengths are the tree's inner nodes, their cuts the children. A word that occurs less than
   ``exponent`` times in its text is in no run, so it ends every suffix, as the text's end does.
2. *Branching tandem repeats.* At a node whose path has ``L`` words, every leaf ``i`` of all children but the largest
   asks whether ``i + L`` or ``i - L`` is a leaf of another child; if so, a square of half-length ``L`` begins at the
   smaller one and can't be moved right. By leaving out the largest child each leaf is asked a logarithmic number
   of times. The tests are array lookups in suffix order, for all nodes of many texts at once.
3. *Runs.* A run of four periods ends in a branching square of ``L`` and one of ``2 L``, so others are left out. Of the
   squares with one right end the shortest is primitive; it is rotated to the left as far as words repeat, and the run that
   this merges has the multiples of ``L`` in it, which are dropped.

Words are compared exactly (numbered per text by a dictionary). Texts are worked in blocks of ``BLOCK_WORDS``; one
text is never cut, so a task's memory is some 200 bytes for each word of its longest text beside a block.

Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows are treated alike, rows have no
order in which ties could matter, an empty table gives no rows. Extra columns pass through under any name; one named
like an output is replaced by it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from worldpulse.llm.shared import let_go, named, others, pack, unpack

BLOCK_WORDS = 50_000
OUTPUTS = ("n_words", "runs", "collapsed")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Run = tuple[int, int, int]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, no two texts sharing one, and a number of its own after each text; and where each text begins."""
    parts, begins, base, at = [], [], 0, 0
    for words in texts:
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        begins.append(at)
        parts += [ids + base, [base + len(known)]]
        base += len(known) + 1
        at += len(words) + 1
    return np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64), np.array(begins, np.int64)


def _sorted_suffixes(s: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at ``active`` places, in order, and the common prefix of each with the one before it.

    A place that isn't active is like no other. ``ranks[k]`` tells stretches of ``2 ** k`` words apart.
    """
    place = np.arange(len(s))
    alone = -1 - place
    ranks = [np.where(active, s, alone)]
    order = np.flatnonzero(active)
    width = int(s.max(initial=0)) + len(s) + 2
    key = ranks[0][order] * width + np.where(active[order + 1], s[order + 1], int(s.max(initial=0)) + 1 + order)
    todo = np.arange(len(order))
    step = 1
    while len(todo):
        by = np.argsort(key, kind="stable")
        order[todo] = order[todo][by]
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = todo[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        rank = ranks[-1].copy() if len(ranks) > 1 else alone.copy()
        rank[order[todo]] = group
        ranks.append(rank)
        last = np.concatenate([new[1:], [True]])
        todo = todo[~(new & last)]
        step *= 2
        # Suffixes that are still alike have ``step`` active words in common, so there is a place behind those.
        key = rank[order[todo]] * (2 * len(s) + 2) + rank[order[todo] + step] + len(s)
    return order, _common(order, ranks)


def _common(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    one, two = order[:-1], order[1:]
    length = np.zeros(len(order), np.int64)
    alike = np.arange(len(one))
    stages = []
    for rank in ranks:
        alike = alike[rank[one[alike]] == rank[two[alike]]]
        if not len(alike):
            break
        stages.append(alike)
    # From the longest power of two that fits downwards; each pair joins at its own.
    begun = np.zeros(len(one), bool)
    for k in range(len(stages) - 1, -1, -1):
        here = stages[k]
        at = length[1:][here]
        more = ranks[k][one[here] + at] == ranks[k][two[here] + at]
        length[1:][here] = at + np.where(begun[here], more, True) * (1 << k)
        begun[here] = True
    return length


def _smaller_before(x: np.ndarray, rounds: int = 30) -> np.ndarray:
    """For each place the last one before it with a smaller value; both ends are -1 and have none.

    Pointers of all places jump together. Long ramps, as periodic texts have, take too many jumps: those go by a stack.
    """
    p = np.maximum(np.arange(len(x)) - 1, 0)
    todo = np.flatnonzero((x[p] >= x) & (x >= 0))
    while len(todo) and rounds:
        p[todo] = p[p[todo]]
        todo = todo[x[p[todo]] >= x[todo]]
        rounds -= 1
    if len(todo):
        values, found, stack = x.tolist(), [], []
        for i, v in enumerate(values):
            while stack and values[stack[-1]] >= v:
                stack.pop()
            found.append(stack[-1] if stack else 0)
            stack.append(i)
        return np.array(found, np.int64)
    return p


def _branching(s: np.ndarray, order: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half-lengths of the branching tandem repeats."""
    none = np.zeros(0, np.int64)
    if not len(order):
        return none, none
    low = np.concatenate([[-1], length[1:], [-1]])
    before = _smaller_before(low)
    after = len(low) - 1 - _smaller_before(low[::-1])[::-1]
    cuts = np.flatnonzero(low > 0)
    if not len(cuts):
        return none, none
    # A node's cuts have its least length and one smaller length before them; they are its children's borders.
    cuts = cuts[np.argsort(before[cuts] * (int(low.max()) + 1) + low[cuts], kind="stable")]
    first = np.concatenate([[True], (before[cuts][1:] != before[cuts][:-1]) | (low[cuts][1:] != low[cuts][:-1])])
    node = np.cumsum(first) - 1
    head = np.flatnonzero(first)
    n_cuts = np.diff(np.concatenate([head, [len(cuts)]]))
    begin = head + np.arange(len(head))
    total = len(cuts) + len(head)
    starts, ends = np.empty(total, np.int64), np.empty(total, np.int64)
    starts[np.arange(len(cuts)) + node + 1] = cuts
    starts[begin] = before[cuts[head]]
    ends[np.arange(len(cuts)) + node] = cuts
    ends[begin + n_cuts] = after[cuts[head]]
    of = np.repeat(np.arange(len(head)), n_cuts + 1)
    size = ends - starts
    largest = np.maximum.reduceat(size, begin)
    kept_out = np.minimum.reduceat(np.where(size == largest[of], np.arange(total), total), begin)
    small = np.ones(total, bool)
    small[kept_out] = False
    child = np.repeat(np.flatnonzero(small), size[small])
    ahead = np.cumsum(size[small])
    leaf = np.arange(len(child)) - np.repeat(ahead - size[small], size[small]) + starts[child]
    at, half = order[leaf], low[cuts[head]][of[child]]
    left, right = before[cuts[head]][of[child]], after[cuts[head]][of[child]]
    rank = np.full(len(s), -1)
    rank[order] = np.arange(len(order))

    def elsewhere(there: np.ndarray) -> np.ndarray:
        r = np.where(there >= 0, rank[there], -1)
        return (r >= left) & (r < right) & ((r < starts[child]) | (r >= ends[child]))

    forward, back = elsewhere(at + half), elsewhere(at - half)
    i, n = np.concatenate([at[forward], (at - half)[back]]), np.concatenate([half[forward], half[back]])
    code = np.unique(i * (len(s) + 1) + n)
    return code // (len(s) + 1), code % (len(s) + 1)


def _reach(s: np.ndarray, i: int, n: int) -> int:
    """The least place from which words equal those ``n`` further on, up to ``i``."""
    width = 16
    while i > 0:
        j = max(0, i - width)
        differ = np.flatnonzero(s[j:i] != s[j + n : i + n])
        if len(differ):
            return j + int(differ[-1]) + 1
        i = j
        width *= 2
    return i


def find_runs(texts: list[list[bytes]], exponent: int, least: int) -> list[list[Run]]:
    """The runs ``(start, length, period)`` of each text's words, by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    s, begins = _numbered(texts)
    if not len(s):
        return out
    active = np.bincount(s)[s] >= max(2, exponent)
    starts, halves = _branching(s, *_sorted_suffixes(s, active))
    if exponent >= 4:
        # The square of so many periods that ends where a run of ``exponent`` periods does.
        m = exponent // 2
        code = starts * (len(s) + 1) + halves
        longer = (starts - 2 * (m - 1) * halves) * (len(s) + 1) + m * halves
        both = np.isin(longer, code) & (starts >= 2 * (m - 1) * halves) & (m * halves <= len(s))
        starts, halves = starts[both], halves[both]
    ends = starts + 2 * halves
    by = np.lexsort((halves, ends))
    here, merged = -1, []
    for i, n, end in zip(starts[by].tolist(), halves[by].tolist(), ends[by].tolist(), strict=True):
        if end != here:
            here, merged = end, []
        if any(n % q == 0 and i >= start for q, start in merged):
            continue
        start = _reach(s, i, n)
        merged.append((n, start))
        if end - start >= max(least, exponent * n):
            k = int(np.searchsorted(begins, start, "right")) - 1
            out[k].append((start - int(begins[k]), end - start, n))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def _found(exponent: int, least: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            # bytes.split() splits at the space and at 9 to 13, as words are defined.
            texts = pc.cast(pc.fill_null(batch.column("text"), ""), pa.large_binary())
            begin = 0
            while begin < len(texts):
                words, n, end = [], 0, begin
                while end < len(texts) and (n < BLOCK_WORDS or end == begin):
                    words.append(texts[end].as_py().split())
                    n += len(words[-1])
                    end += 1
                runs = find_runs(words, exponent, least)
                flat = [{"start": a, "length": b, "period": c} for own in runs for a, b, c in own]
                listed = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32), pa.array(flat, _RUN))
                collapsed = pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(begin, end - begin), pa.array([len(w) for w in words], pa.int64()), listed, collapsed], names=["row", *OUTPUTS])
                begin = end

    return emit


def collapse_runs(docs: DataFrame, text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``runs`` (``start``, ``length`` and ``period`` in words) and the ``collapsed`` text."""
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    keep = others(docs, text_col, *OUTPUTS)
    packed = pack(docs, keep, text=named(text_col))
    row = packed.schema["row"].dataType.simpleString()
    found = packed.mapInArrow(_found(exponent, least), f"row {row}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.select(*unpack(keep), *OUTPUTS)
