"""Operator 5, language identification by prediction by partial matching.

Each language has a byte context tree of order ``ORDER``: for every context of up to that many bytes,
the counts of the bytes that followed it. A byte's code length under a language is that of the longest
context that predicts it, plus an escape for each longer one that doesn't (method C: of a context seen
n times with d distinct followers, a follower seen c times has probability c / (n + d), the escape
d / (n + d)); a context never seen is skipped at no cost, and below order 0 all 256 bytes are equally
likely. Statistics are frozen after training, so a text's code length is an exact sum that doesn't
depend on the order of rows. The shortest code names the language; the score is that language's share
of the likelihoods, spread by the square root of the text's length so that a handful of bytes does not
pass for certainty.

Code lengths are worked out at training, vectorised, for the contexts and bytes that were seen: a hash table
leads from (context, byte) to one row of code lengths, another from a context to its escape costs, which are
added where a byte was never seen there, and the search goes on with the next shorter context. Languages are
held in blocks of ``LANGUAGE_BLOCK``, so tables grow with the training text and not with its square.

Training reads at most ``train_bytes`` per language and ``total_bytes`` in all (with more languages each gets
less), from the distinct texts of least hash (a bounded sample that doesn't depend
on partitioning), and of each at most a ``TEXTS``-th of that, in pieces spread over the text, unless a
language has too few texts for that. That text, a fixed
bound, is broadcast and each Python process builds the trees from it once.

Null texts and texts without a letter get ``und`` and score 0, and 8 bits a byte. With no training rows all
texts do. A training label ``und`` is learnt like any other. Very long texts are scored whole, in blocks of bytes.
Repeated rows are scored each, equal code lengths go to the language that sorts first. An empty table gives no
rows. Extra columns pass through under any name; one named like an output is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldpulse.llm.shared import materialize, named, one_per_process, others, pack, small_table, unpack

ORDER = 3
TRAIN_BYTES = 200_000
UNKNOWN = "und"
UNIFORM_BITS = 8.0
#: Bytes of training text of all languages together, and languages whose code lengths share a table.
TOTAL_BYTES, LANGUAGE_BLOCK = 8_000_000, 16
#: So many texts fill a language's training text at least, if there are; a longer one gives so many pieces.
TEXTS, PIECES = 32, 4
BLOCK = 1 << 18
OUTPUTS = ("lang_pred", "score", "bits_per_byte")
LETTER = regex.compile(r"\p{L}")


def _grams(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ``n`` bytes, packed into integers and sorted, and how often each occurs."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    packed = np.zeros(max(0, len(b) - n + 1), np.uint64)
    for k in range(n):
        packed = packed << np.uint64(8) | b[k : len(b) - n + 1 + k]
    return np.unique(packed, return_counts=True)


class _Rows:
    """A hash table from unsigned 64-bit keys to row numbers, looked up for many keys at a time."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rows = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._slots(keys)
        while len(todo):
            free = self.rows[at[todo]] < 0
            # Of keys that want one free slot the last one written has it; the others go on to the next slot.
            self.rows[at[todo[free]]] = todo[free]
            todo = todo[self.rows[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        taken = self.rows >= 0
        self.keys[taken] = keys[self.rows[taken]]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        at = self._slots(keys)
        found = self.rows[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (found >= 0))
        found[open_] = -1
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.rows[at[open_]]
            same = self.keys[at[open_]] == keys[open_]
            found[open_[same & (there >= 0)]] = there[same & (there >= 0)]
            open_ = open_[~same & (there >= 0)]
        return found


def _tagged(packed: np.ndarray, n: int) -> np.ndarray:
    """Keys of contexts of ``n`` bytes (and of what follows) that differ from those of any other length."""
    return packed | np.uint64((n + 1) << 56)


class ContextTrees:
    """The frozen trees of a block of languages: code lengths of what was seen, and escape costs of contexts."""

    def __init__(self, texts: dict[str, bytes], order: int = ORDER) -> None:
        self.order, self.languages = order, sorted(texts)
        seen = [[_grams(texts[x], n) for n in range(order + 2)] for x in self.languages]
        keys, bits, contexts, escapes = [], [], [], []
        shorter = np.zeros(0, np.uint64)
        for n in range(order + 1):
            grams = np.unique(np.concatenate([s[n + 1][0] for s in seen]))
            around = np.unique(grams >> np.uint64(8))
            suffix = grams & np.uint64((1 << 8 * n) - 1)
            cost = bits[-1][np.searchsorted(shorter, suffix)] if n else np.full((len(grams), len(seen)), UNIFORM_BITS)
            escape = np.zeros((len(around), len(seen)))
            for x, s in enumerate(seen):
                own, counts = s[n + 1]
                context, first = np.unique(own >> np.uint64(8), return_index=True)
                distinct = np.diff(np.r_[first, len(own)])
                total = np.add.reduceat(counts, first) + distinct if len(own) else np.zeros(0)
                escape[np.searchsorted(around, context), x] = np.log2(total / distinct)
                cost[:, x] += escape[np.searchsorted(around, grams >> np.uint64(8)), x]
                cost[np.searchsorted(grams, own), x] = np.log2(np.repeat(total, distinct) / counts)
            keys.append(_tagged(grams, n))
            bits.append(cost)
            contexts.append(_tagged(around, n))
            escapes.append(escape)
            shorter = grams
        self.bits, self.escapes = np.concatenate(bits), np.concatenate(escapes)
        self.seen, self.contexts = _Rows(np.concatenate(keys)), _Rows(np.concatenate(contexts))

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of the whole text under each language, summed block by block."""
        total = np.zeros(len(self.languages))
        for at in range(0, len(data), BLOCK):
            begin = max(0, at - self.order)
            b = np.frombuffer(data[begin : at + BLOCK], np.uint8).astype(np.uint64)
            packed = b.copy()
            for back in range(1, self.order + 1):
                packed[back:] |= b[:-back] << np.uint64(8 * back) if back < len(b) else np.uint64(0)
            # A text's first bytes have shorter contexts.
            longest = np.minimum(np.arange(len(b)) + begin, self.order)
            todo = np.arange(at - begin, len(b))
            for n in range(self.order, -1, -1):
                reach = longest[todo] >= n
                now, later = todo[reach], todo[~reach]
                own = packed[now] & np.uint64((1 << 8 * (n + 1)) - 1)
                rows = self.seen.find(_tagged(own, n))
                met = rows >= 0
                total += np.bincount(rows[met], minlength=len(self.bits)) @ self.bits if met.sum() > len(self.bits) else self.bits[rows[met]].sum(axis=0)
                rest = now[~met]
                around = self.contexts.find(_tagged(own[~met] >> np.uint64(8), n))
                total += self.escapes[around[around >= 0]].sum(axis=0)
                todo = np.concatenate([later, rest]) if len(later) else rest
            total += UNIFORM_BITS * len(todo)
        return total


class Identifier:
    """The trees of all languages, block by block."""

    def __init__(self, texts: dict[str, bytes], order: int = ORDER) -> None:
        self.languages = sorted(texts)
        blocks = [self.languages[i : i + LANGUAGE_BLOCK] for i in range(0, len(texts), LANGUAGE_BLOCK)]
        self.trees = [ContextTrees({x: texts[x] for x in block}, order) for block in blocks]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """The language, its share of the likelihoods, and the bits a byte of its code."""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, UNIFORM_BITS
        data = text.encode("utf-8", "surrogatepass")
        bits = np.concatenate([t.code_lengths(data) for t in self.trees])
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(np.maximum((bits[best] - bits) / np.sqrt(len(data)), -1000)).sum()), float(bits[best] / len(data))


def _pieces(text: Column, most: Column) -> Column:
    """``text``, or about ``most`` bytes of it in ``PIECES`` pieces spread evenly over it."""
    chars = F.char_length(text)
    size = F.ceil(most.cast("double") * chars / F.octet_length(text) / PIECES).cast("int")
    parts = [F.substring(text, F.floor((chars - size).cast("double") * k / (PIECES - 1)).cast("int") + 1, size) for k in range(PIECES)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat_ws("\n", *parts))


def learn(docs: DataFrame, train_bytes: int = TRAIN_BYTES, text_col: str = "text", lang_col: str = "lang", total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Training text of each language from labelled ``docs``, at most ``train_bytes`` each and ``total_bytes`` in all.

    What a language's distinct texts can give, each up to its bound, says which share of the hash range
    holds a few times ``train_bytes``. Shares that turn out to hold less are doubled until they don't or are 1.
    Only texts in the share are exchanged, copies as one, and the least hashes that fill the bound stay.
    """
    rows = docs.select(named(lang_col).alias("lang"), F.octet_length(named(text_col)).cast("long").alias("n"), F.xxhash64(named(text_col)).alias("h"), named(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("n").isNotNull())
    # Narrow rows, one for each distinct text.
    narrow = materialize(rows.groupBy("lang", "h").agg(F.max("n").alias("n")), "op5-texts")
    train_bytes = max(1, min(train_bytes, total_bytes // max(1, narrow.select("lang").distinct().count())))
    bounds = sorted({max(1, train_bytes // k) for k in (TEXTS, TEXTS // 2, TEXTS // 4, TEXTS // 8, TEXTS // 16, 1)})
    sums = [F.sum(F.least("n", F.lit(x))).alias(f"b{x}") for x in bounds]
    totals = {r["lang"]: r for r in narrow.groupBy("lang").agg(*sums).collect()}
    if not totals:
        return {}
    bound = {x: next((b for b in bounds if r[f"b{b}"] >= 2 * train_bytes), bounds[-1]) for x, r in totals.items()}
    share = {x: min(1.0, 4.0 * train_bytes / max(1, r[f"b{bound[x]}"])) for x, r in totals.items()}
    place = (F.shiftright("h", 11) + F.lit(2**52)) / F.lit(2.0**53)

    def shared(df: DataFrame) -> DataFrame:
        # One small row per language, so no text is exchanged to find its share.
        of = small_table(docs.sparkSession, [(x, share[x], bound[x]) for x in sorted(share)], "of string, share double, bound long")
        return df.join(F.broadcast(of), F.col("lang") == F.col("of")).filter(place < F.col("share"))

    while True:
        drawn = shared(narrow).groupBy("lang").agg(F.sum(F.least("n", "bound")).alias("n"))
        got = {r["lang"]: r["n"] for r in drawn.collect()}
        short = [x for x in share if share[x] < 1 and got.get(x, 0) < 2 * train_bytes]
        if not short:
            break
        share |= {x: min(1.0, 2 * share[x]) for x in short}
    whole = shared(rows).groupBy("lang", "h").agg(F.first(_pieces(F.col("text"), F.col("bound"))).alias("text"))
    sample = whole.withColumn("n", F.octet_length("text").cast("long"))
    running = F.sum("n").over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    kept = sample.withColumn("before", F.coalesce(running, F.lit(0))).filter(F.col("before") < train_bytes)
    found: dict[str, bytes] = {}
    for r in kept.select("lang", "h", "text").orderBy("lang", "h").collect():
        found[r["lang"]] = (found.get(r["lang"], b"") + r["text"].encode() + b"\n")[:train_bytes]
    return found


def identify(docs: DataFrame, training: dict[str, bytes], order: int = ORDER, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``."""
    keep = others(docs, *OUTPUTS)
    return found(docs, keep, training, order, text_col).select(*unpack(keep), "found.*")


def found(docs: DataFrame, keep: list[str], training: dict[str, bytes], order: int = ORDER, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` as a struct ``row`` beside a struct ``found`` of the outputs."""
    shared = docs.sparkSession.sparkContext.broadcast(training)
    key = hashlib.sha256(repr((sorted(training.items()), order)).encode()).hexdigest()

    @F.pandas_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = one_per_process(("trees", key), lambda: Identifier(shared.value, order))
        for texts in batches:
            yield pd.DataFrame([trees.predict(t) for t in texts], columns=list(OUTPUTS))

    return pack(docs, keep, found=predict(named(text_col)))
