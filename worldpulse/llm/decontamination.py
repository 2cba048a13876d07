"""Operator 8, benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised byte for byte (A-Z lower-cased, separators to spaces), so that offsets in the
normalised text are offsets in the original. The benchmark's windows of ``window`` words - a whole
item where it has fewer - become the patterns of one automaton, each with a space at both ends; a
document's words, joined by single spaces, run through it once. Each match marks its words as hit
and names the items that hold the window.

The automaton is built once per Python process from a broadcast of at most ``max_pattern_bytes``. A larger
benchmark is first asked which of its windows occur at all: a bitmap of window hashes, of bounded size, is
broadcast, and one scan notes each document's windows that are in it. Only windows so noted become patterns, and
only documents with some are scanned by the automaton (by one per ``max_pattern_bytes`` of patterns, their marks
united per row). A full bitmap lets more windows through and leaves none out, so the result is the same at any size.

Null and word-less texts have no words, no hits and aren't contaminated; neither is anything in an empty table.
Null benchmark texts give no window, an empty benchmark no hit. Repeated documents or items count like any other;
the item list has each id once, in order. Very long texts are scanned whole. Extra columns pass through under any
name; one named like an output is replaced by it, but :func:`decontaminate` returns all columns as they were.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldpulse.llm.shared import materialize, named, one_per_process, others, pack, unpack
from worldpulse.llm.shingles import window_hashes, word_hashes

WINDOW = 13
MAX_PATTERN_BYTES = 4_000_000
#: Bits of the bitmap of windows: 16 for each, up to this many.
MOST_BITS = 1 << 29
#: In folded bytes every separator is a space.
WORD = regex.compile(rb"[^ ]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

MARKS = "struct<n_words:long,hits:array<struct<first:int,last:int>>,spans:array<struct<start:int,end:int>>,items:array<string>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def normalised(text: str) -> list[bytes]:
    return [w for w in words_of(text) if w]


def windows(texts: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """The distinct windows of a benchmark with the sorted ids of their items."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                w = [x.decode() for x in normalised(t)] if t else []
                out.append([" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else [])
            yield pd.Series(out, dtype=object)

    found = texts.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.explode(cut(F.col(text_col))).alias("window"))
    return found.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Scanner:
    """The automaton over one block of windows."""

    def __init__(self, block: list[tuple[str, list[str]]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for window, items in block:
            # One character per byte, as the scanned text has it.
            self.automaton.add_word(f" {window} ".encode().decode("latin-1"), (window.count(" ") + 1, items))
        if block:
            self.automaton.make_automaton()
        self.empty = not block

    def scan(self, text: str | None) -> tuple:
        """``(n_words, hit word ranges, character spans, item ids)``."""
        words = normalised(text) if text else []
        if not words or self.empty:
            return len(words), [], [], []
        found = list(self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not found:
            return len(words), [], [], []
        ends = np.cumsum([len(w) + 1 for w in words])
        last = np.searchsorted(ends, [end for end, _ in found])
        ranges: list[list[int]] = []
        for a, b in sorted((int(k) - n + 1, int(k)) for k, (_, (n, _)) in zip(last, found, strict=True)):
            if ranges and a <= ranges[-1][1] + 1:
                ranges[-1][1] = max(ranges[-1][1], b)
            else:
                ranges.append([a, b])
        raw = text.encode("utf-8", "surrogatepass")
        # The character that each byte belongs to: continuation bytes don't begin one.
        char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        at = [(m.start(), m.end()) for m in WORD.finditer(raw.translate(_FOLD))]
        spans = [(int(char[at[a][0]]) - 1, int(char[at[b][1] - 1])) for a, b in ranges]
        return len(words), ranges, spans, sorted({x for _, (_, items) in found for x in items})


def _scan(rows: DataFrame, block: list[tuple[str, list[str]]]) -> Column:
    """The marks of the column ``text`` of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    key = hashlib.sha256(repr(block).encode()).hexdigest()

    @F.pandas_udf(MARKS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = one_per_process(("scan", key), lambda: Scanner(shared.value))
        for texts in batches:
            yield pd.DataFrame([s.scan(t) for t in texts], columns=["n_words", "hits", "spans", "items"])

    return scan(named("text"))


def _word_hashes(text: str | None) -> np.ndarray:
    return word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8))[0] if text else np.zeros(0, np.uint64)


def _hashed(patterns: DataFrame) -> DataFrame:
    """``patterns`` with the hash of each window and its number of words."""

    @F.pandas_udf("long")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([window_hashes(_word_hashes(t), {t.count(" ") + 1}).view(np.int64)[0] for t in batch], dtype="int64")

    return patterns.withColumns({"h": of("window"), "size": F.size(F.split("window", " "))})


def _noted(rows: DataFrame, patterns: DataFrame, most_bits: int) -> DataFrame:
    """``(at, n_words, found)``: each row's distinct window hashes that are in a bitmap of those of ``patterns``."""
    bits = min(most_bits, max(1 << 16, 1 << (16 * patterns.count()).bit_length()))
    sizes = {r["size"] for r in patterns.select("size").distinct().collect()}
    place = F.pmod(F.col("h"), F.lit(bits))
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in patterns.select(F.floor(place / 32_768).alias("bucket"), (place % 32_768).alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).toLocalIterator():
        bitmap[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("struct<n_words:long,found:array<long>>")
    def note(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                words = _word_hashes(t)
                h = window_hashes(words, sizes).view(np.int64)
                bit = h % bits
                out.append((len(words), np.unique(h[(shared.value[bit >> 3] >> (bit & 7)) & 1 == 1]).tolist()))
            yield pd.DataFrame(out, columns=["n_words", "found"])

    return materialize(rows.select("at", note("text").alias("noted")).select("at", "noted.*"), "op8-noted")


def _merged(ranges: Column, first: str, last: str, gap: int) -> Column:
    """Sorted ranges with those that overlap or touch made one."""
    empty = F.array().cast(f"array<struct<{first}:int,{last}:int>>")

    def add(done: Column, x: Column) -> Column:
        before = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (x[first] <= before[last] + gap)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(before[first].alias(first), F.greatest(before[last], x[last]).alias(last))))
        return F.when(joins, grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), empty, add)


def _marked(rows: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text_col: str, max_pattern_bytes: int, most_bits: int) -> DataFrame:
    """``rows(row, text)`` as ``(row, marks)``."""
    patterns = windows(benchmark, window, item_col, item_text_col)
    weight = F.octet_length("window") + 2 + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x))

    def weigh(part: DataFrame) -> int:
        return part.agg(F.sum(weight.cast("long"))).first()[0] or 0

    def block(part: DataFrame) -> list[tuple[str, list[str]]]:
        return [(r["window"], list(r["items"])) for r in part.orderBy("window").collect()]

    patterns = materialize(patterns, "op8-windows")
    if weigh(patterns) <= max_pattern_bytes:
        return rows.select("row", _scan(rows, block(patterns)).alias("marks"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    patterns = materialize(_hashed(patterns), "op8-hashed")
    noted = _noted(rows, patterns, most_bits)
    met = noted.filter(F.size("found") > 0)
    asked = materialize(met.select(F.explode("found").alias("h")).distinct(), "op8-asked")
    patterns = materialize(patterns.join(asked, "h", "left_semi").select("window", "items"), "op8-occurring")
    few = materialize(rows.join(met.select("at"), "at", "left_semi").select("at", "text"), "op8-candidates")
    blocks = max(1, -(-2 * weigh(patterns) // max_pattern_bytes))
    parts = [few.select("at", _scan(few, block(patterns.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k))).alias("m")) for k in range(blocks)]
    every = functools.reduce(DataFrame.unionByName, parts).filter(F.size("m.hits") > 0)
    united = every.groupBy("at").agg(*[F.flatten(F.collect_list(f"m.{c}")).alias(c) for c in ("hits", "spans", "items")])
    found = F.struct(_merged(F.col("hits"), "first", "last", 1).alias("hits"), _merged(F.col("spans"), "start", "end", 0).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    joined = rows.select("row", "at").join(noted.select("at", "n_words"), "at").join(united.select("at", found.alias("found")), "at", "left")
    none = {"hits": "array<struct<first:int,last:int>>", "spans": "array<struct<start:int,end:int>>", "items": "array<string>"}
    return joined.select("row", F.struct("n_words", *[F.coalesce(f"found.{c}", F.array().cast(t)).alias(c) for c, t in none.items()]).alias("marks"))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_pattern_bytes: int = MAX_PATTERN_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with a struct ``marks``: ``n_words``, hit word ranges, their character spans in the text, and item ids."""
    keep = others(docs, "marks")
    rows = pack(docs, keep, text=named(text_col))
    return _marked(rows, benchmark, window, item_col, item_text_col, max_pattern_bytes, most_bits).select(*unpack(keep), "marks")


def _counted(marks: str = "marks") -> dict[str, Column]:
    hit = F.aggregate(f"{marks}.hits", F.lit(0).cast("long"), lambda n, x: n + (x["last"] - x["first"] + 1).cast("long"))
    return {"n_words": F.col(f"{marks}.n_words"), "n_hit": hit, "n_items": F.size(f"{marks}.items").cast("long"), "items": F.array_join(f"{marks}.items", ",")}


def _is_contaminated() -> Column:
    """At least one word in twenty is hit."""
    counts = _counted()
    return (counts["n_hit"] > 0) & (20 * counts["n_hit"] >= counts["n_words"])


def contamination(marked: DataFrame) -> DataFrame:
    """``marked`` with counts, the item list and the verdict."""
    counts = _counted()
    keep = others(marked, *counts, "contaminated")
    return marked.select(*[named(c) for c in keep], *[c.alias(name) for name, c in counts.items()], _is_contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    rows = pack(docs, docs.columns, text=named(text_col))
    marked = _marked(rows, benchmark, WINDOW, "item_id", "text", MAX_PATTERN_BYTES, MOST_BITS)
    return marked.filter(~_is_contaminated()).select(*unpack(docs.columns))
