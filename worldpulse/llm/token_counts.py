"""Operator 1, token counts by a compiled finite-state transducer.

**Machine.** Inside one pre-token, byte-pair encoding is a deterministic transducer over bytes. Its
state holds, for each suffix of the input that is still a proper prefix of some token, the last token
of the encoding before that suffix and how many tokens that encoding has, counted from here. Reading a
byte picks the longest token that ends at it and that the merge rules would put beside the token
before it; the transition is annotated with the change of the emitted-token count (it may be negative:
``ab`` can be two tokens where ``abc`` is one). States are determinised when a text first reaches them
and kept in a table of bounded size which is emptied when it is full, as regular-expression engines do.

Between two bytes that are adjacent inside no token, and wherever a pre-token ends, the machine always restarts,
whatever came before.

**Chunks.** A text longer than ``chunk_chars`` is cut into chunks anywhere, and each chunk becomes a state map:
for the states in which it may be entered, the state it is left in and the tokens counted on the way. A chunk knows
``LOOK`` characters before it. As a rule a restart is among them, so the one state of entry is certain. In a pre-token
that runs on for longer without any restart (one letter a million times) the machine is run from several places
before the chunk, and each state reached is an entry; such a map keeps the text of that stretch, to be run again
for a state that isn't among them. Maps compose associatively, so chunks are mapped in parallel, spread over the
cluster, and a balanced scan composes them; it is the same for unbroken text in any script. Texts up to
``chunk_chars`` never leave their task. The table is scanned once; long texts are stored to be cut up.

Nulls count as empty text: 0 bytes, 0 tokens. Rows have no order in which ties could matter; repeated rows each keep
a row of their own (rows of chunks meet by a row key, not by ``doc_id``). An empty table gives no rows. Extra columns
pass through under any name; one named like an output is replaced by it.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldpulse.llm.shared import materialize, named, one_per_process, others, pack, unpack
from worldpulse.llm.vocabulary import Vocabulary

CHUNK_CHARS = 65_536
MAP = "struct<steps:array<struct<entry:string,exit:string,n:long>>,rest:string,more:long,left:string>"
MAX_TRANSITIONS = 300_000
MAX_WORDS = 100_000

#: Characters that a chunk knows before and after it. Of those before it the first ``DOUBTFUL`` may be cut into
#: pre-tokens wrongly, as what precedes them isn't known; what it depends on reaches a few characters back.
LOOK, AHEAD, DOUBTFUL = 1_024, 64, 64
#: Places to run from where no restart is known.
GUESSES = 16

State = tuple[tuple[bytes, int, int], ...]
START: State = ((b"", -1, 0),)


def written(state: State) -> str:
    return "" if state == START else repr(state)


def read(state: str) -> State:
    return ast.literal_eval(state) if state else START


class CountTransducer:
    """Lazily determinised counting transducer for the bytes of one pre-token."""

    def __init__(self, vocab: Vocabulary, max_transitions: int = MAX_TRANSITIONS, max_words: int = MAX_WORDS) -> None:
        names = list(vocab.added)
        if any(len(x) > DOUBTFUL // 2 or any(x[i:] == y[: len(x) - i] for y in names for i in range(1, len(x))) for x in names):
            raise ValueError("added tokens that are long or overlap can't be found from a few characters around")
        self.vocab, self.max_transitions, self.max_words = vocab, max_transitions, max_words
        self.name_of = {i: name for name, i in vocab.added.items()}
        self.prefixes = {b[:i] for b in vocab.id_of for i in range(1, len(b))}
        inside = np.zeros(65_536, bool)
        for b in vocab.id_of:
            for i in range(len(b) - 1):
                inside[b[i] << 8 | b[i + 1]] = True
        self.certain_cut = ~inside
        self.beside: dict[tuple[int, int], bool] = {}
        # Two generations: a full table becomes the old one, and what is still in use moves back.
        self.words: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        # A state lists (open suffix, last token before it or -1, tokens before it relative to now), shortest first.
        self.states, self.ids, self.arcs = [START], {START: 0}, {}

    def _number(self, state: State) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
        return self.ids[state]

    def _agrees(self, left: int, right: int) -> bool:
        """Whether the merge rules leave ``left`` and ``right`` as they are when one follows the other."""
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) >= self.max_transitions:
                self.beside.clear()
            b = self.vocab.bytes_of
            known = self.beside[left, right] = self.vocab.merge((b[left] if left >= 0 else b"") + b[right]) == ([left, right] if left >= 0 else [right])
        return known

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        last = bytes([byte])
        source = self.states[state]
        before = source[0][1]
        if before >= 0 and self.certain_cut[self.vocab.bytes_of[before][-1] << 8 | byte]:
            source = START
        for suffix, before, relative in reversed(source):
            token = self.vocab.id_of.get(suffix + last)
            if token is not None and self._agrees(-1, token) and (before < 0 or self._agrees(before, token)):
                break
        delta = relative + 1
        target = ((b"", token, 0), *((s + last, p, r - delta) for s, p, r in source if s + last in self.prefixes))
        arc = self.arcs[state << 8 | byte] = self._number(target), delta
        return arc

    def word(self, piece: str) -> int:
        """The tokens of one pre-token."""
        count = self.old.get(piece) or self._run(piece)
        if len(piece) <= 64:
            if len(self.words) >= self.max_words:
                self.old = dict(self.words)
                self.words.clear()
            self.words[piece] = count
        return count

    def _run(self, piece: str) -> int:
        return self.advance(START, piece.encode())[1]

    def advance(self, state: State, data: bytes) -> tuple[State, int]:
        """The state after ``data`` inside a pre-token, and the change of the count."""
        at, count = self._number(state), 0
        arcs = self.arcs
        for byte in data:
            arc = arcs.get(at << 8 | byte)
            if arc is None:
                if len(arcs) >= self.max_transitions:
                    now = self.states[at]
                    self._reset()
                    arcs, at = self.arcs, self._number(now)
                arc = self._arc(at, byte)
            at, delta = arc
            count += delta
        return self.states[at], count

    def count(self, text: str) -> int:
        """The tokens of a whole text."""
        total, get = 0, self.words.get
        for part in self.vocab.parts(text):
            if isinstance(part, int):
                total += 1
                continue
            for piece in self.vocab.pattern.findall(part):
                n = get(piece)
                total += self.word(piece) if n is None else n
        return total

    def _pieces(self, text: str) -> Iterator[tuple[int, int, str | None]]:
        """``(begin, end, pre-token)``, without the pre-token for an added token."""
        at = 0
        for part in self.vocab.parts(text):
            if isinstance(part, int):
                end = at + len(self.name_of[part])
                yield at, end, None
                at = end
                continue
            for piece in self.vocab.pattern.findall(part):
                yield at, at + len(piece), piece
                at += len(piece)

    def _entries(self, text: str, begin: int, a: int, from_start: bool) -> tuple[list[State], bool]:
        """The states in which the pre-token that runs from ``begin`` over ``a`` may be at ``a``, and whether that is certain."""
        if from_start or begin >= DOUBTFUL:
            return [self.advance(START, text[begin:a].encode())[0]], True
        data = text[DOUBTFUL:a].encode()
        b = np.frombuffer(data, np.uint8).astype(np.int32)
        cuts = np.flatnonzero(self.certain_cut[b[:-1] << 8 | b[1:]]) + 1
        if len(cuts):
            return [self.advance(START, data[cuts[0] :])[0]], True
        return list(dict.fromkeys(self.advance(START, data[k:])[0] for k in range(min(GUESSES, len(data))))), False

    def state_map(self, before: str, chunk: str, after: str, from_start: bool) -> StateMap:
        """The map of ``chunk``; ``from_start`` says that ``before`` begins where the text does."""
        text = before + chunk + after
        a, b = len(before), len(before) + len(chunk)
        entries, certain = [START], True
        first: tuple[str, int] | None = None
        rest, more, left = "", 0, None
        for begin, end, piece in self._pieces(text):
            if end <= a:
                continue
            if begin >= b:
                break
            if piece is None:
                more += begin >= a
            elif begin < a:
                entries, certain = self._entries(text, begin, a, from_start)
                rest = text[a : min(end, b)]
                left = None if end > b else START
            elif end <= b:
                more += self.word(piece)
            else:
                left, n = self.advance(START, piece[: b - begin].encode())
                more += n
        if rest and left is None:
            table = {e: self.advance(e, rest.encode()) for e in entries}
        else:
            table = {e: (left or START, more + (self.advance(e, rest.encode())[1] if rest else 0)) for e in entries}
        return StateMap({written(e): (written(x), n) for e, (x, n) in table.items()}, None if certain else rest, more, None if rest and left is None else written(left or START))

    def follow(self, parts: list[StateMap], state: str) -> tuple[str, int] | None:
        """The way of one state through neighbouring maps; None for a state that can't have been there."""
        total = 0
        for m in parts:
            step = m.table.get(state)
            if step is None:
                if m.rest is None:
                    return None
                found, n = self.advance(read(state), m.rest.encode())
                step = (written(found) if m.left is None else m.left), n + m.more
            state, total = step[0], total + step[1]
        return state, total

    def fold(self, maps: list[StateMap]) -> int:
        """Compose the maps of a whole text pairwise, level by level, and apply the result to the start state."""
        level = [(m.table, [m]) for m in maps]
        while len(level) > 1:
            level = [self._compose(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        table, parts = level[0]
        return (table.get("") or self.follow(parts, ""))[1]

    def _compose(self, left: tuple, right: tuple) -> tuple:
        table = {}
        for entry, (between, n) in left[0].items():
            step = right[0].get(between) or self.follow(right[1], between)
            if step is not None:
                table[entry] = step[0], n + step[1]
        return table, left[1] + right[1]


class StateMap(NamedTuple):
    """``table``: entry -> (exit, tokens). Where entries aren't certain, ``rest`` is the stretch of the pre-token entered,
    ``more`` the tokens counted after it and ``left`` the exit, if the pre-token ends in the chunk."""

    table: dict[str, tuple[str, int]]
    rest: str | None = None
    more: int = 0
    left: str | None = None


def machine(raw: str) -> CountTransducer:
    """One per Python process and vocabulary; its tables outlive a task."""
    return one_per_process(("count", raw), lambda: CountTransducer(Vocabulary(raw)))


def count_tokens(docs: DataFrame, vocab_path: str, text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """All columns of ``docs`` but the text, with ``n_bytes`` and ``n_tokens``.

    ``vocab_path`` is read on the driver; the file (a few MB, fixed by the vocabulary) is broadcast.
    """
    with open(vocab_path, encoding="utf-8") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = others(docs, text_col, "n_bytes", "n_tokens")
    text = F.coalesce(named(text_col), F.lit(""))
    # A text of at most chunk_chars bytes has no more characters; octet_length needs no pass over it.
    rows = pack(docs, keep, text=text, n_bytes=F.octet_length(text).cast("long")).withColumn("short", F.col("n_bytes") <= chunk_chars)

    @F.pandas_udf("long")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = machine(raw.value)
        for texts in batches:
            yield pd.Series([None if t is None else m.count(t) for t in texts], dtype="Int64")

    @F.pandas_udf(MAP)
    def mapped(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        m = machine(raw.value)
        for columns in batches:
            maps = [m.state_map(*x) for x in zip(*columns, strict=True)]
            yield pd.DataFrame([([{"entry": e, "exit": x, "n": n} for e, (x, n) in s.table.items()], s.rest, s.more, s.left) for s in maps], columns=["steps", "rest", "more", "left"])

    @F.pandas_udf("long")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = machine(raw.value)
        for lists in batches:
            yield pd.Series([m.fold([StateMap({s["entry"]: (s["exit"], s["n"]) for s in x["steps"]}, x["rest"], x["more"], x["left"]) for x in maps]) for maps in lists], dtype="int64")

    counted = rows.select("row", "n_bytes", whole(F.when(F.col("short"), F.col("text"))).alias("n_tokens"), F.when(~F.col("short"), F.col("text")).alias("text"))
    counted = materialize(counted.withColumn("key", F.monotonically_increasing_id()), "op1-counts")
    done, long = counted.filter("n_tokens is not null"), counted.filter("n_tokens is null")
    starts = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / chunk_chars).cast("int"))

    def chunk(k: Column) -> Column:
        begin = k * chunk_chars
        look = F.least(begin, F.lit(LOOK))
        return F.struct(
            F.substring(F.col("text"), begin - look + 1, look).alias("before"),
            F.substring(F.col("text"), begin + 1, F.lit(chunk_chars)).alias("chunk"),
            F.substring(F.col("text"), begin + chunk_chars + 1, F.lit(AHEAD)).alias("after"),
            (begin <= LOOK).alias("from_start"),
        )

    chunks = long.select("key", F.posexplode(F.transform(starts, chunk)).alias("at", "c"))
    maps = chunks.repartition("key", "at").select("key", "at", mapped("c.before", "c.chunk", "c.after", "c.from_start").alias("map"))
    joined = maps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "map"))).alias("maps"))
    totals = joined.select("key", folded(F.transform("maps", lambda x: x["map"])).alias("n_tokens"))
    found = long.select("key", "row", "n_bytes").join(totals, "key")
    return done.select("row", "n_bytes", "n_tokens").unionByName(found.select("row", "n_bytes", "n_tokens")).select(*unpack(keep), "n_bytes", "n_tokens")
