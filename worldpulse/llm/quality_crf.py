"""Operator 4, a quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad from its own features, those of the line before and after, and the
labels beside it. Forward-backward gives each line's probability of being good; a document's quality is
their mean, weighted by the lines' lengths, so a text is judged by how much of it is good. Only texts
carry labels, so training alternates: at first each line has its text's label; then the lines of bad
texts that the field finds good are called good (all but the worst, if it finds all good), and the field
is fitted again. A last step bends the score so that 0.7 is where the training texts divide best.

Training reads about ``train_docs`` labelled texts per label, of any length: labels are joined to documents
first, and of the texts with lines that have a label those are drawn whose hash is below the share that gives
so many, fewer of them if they have over ``train_lines`` lines in all. Texts of over ``CHAIN_LINES`` lines
are trained as chains of so many, and those of over ``text_lines`` give that many lines, in chains spread
over the text. Only line features come to the driver. Repeats of an id and text count once. Without texts
of both labels nothing can be learnt: every score is 0.5, and the field isn't ``known``.

Null, empty and blank texts have no lines and score 0.5. Repeated ids of ``labels`` count once, with the
lowest label; repeated documents are scored each. Texts are read whole; of a very long one the lines and their
features are held, its characters are classed in blocks. An empty table gives no rows. Extra columns pass
through under any name; one named like an output is replaced by it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldpulse.llm.shared import let_go, materialize, named, others, pack, small_table, unpack

TRAIN_DOCS = 1_500
#: Lines to train on: per label (the text that reaches the bound is the last), per text, and per chain.
MAX_TRAIN_LINES, MAX_TEXT_LINES, CHAIN_LINES = 100_000, 20_000, 500
THRESHOLD = 0.7
BLOCK_CHARS = 1_000_000
ROUNDS = 3
STEPS = 150
#: Character classes that lines are described by.
SYMBOLS = "#*$%&|<>@^~_=+\\/[]{}"
SHOUTS = "!?"
OWN = 12
WORD = re.compile(r"\S+")
LETTER, UPPER, DIGIT, SPACE, SYMBOL, SHOUT, OTHER = range(7)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for k in range(0x110000):
        c = chr(k)
        if c.isupper():
            table[k] = UPPER
        elif c.isalpha():
            table[k] = LETTER
        elif c.isdigit():
            table[k] = DIGIT
        elif c.isspace():
            table[k] = SPACE
    for c in SYMBOLS:
        table[ord(c)] = SYMBOL
    for c in SHOUTS:
        table[ord(c)] = SHOUT
    return table


def _kinds(lines: list[str], lengths: np.ndarray) -> np.ndarray:
    """How many characters of each class every line has, about ``BLOCK_CHARS`` characters at a time."""
    kinds = np.zeros((len(lines), 7), np.float32)
    classes = _classes()
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lines):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - lengths[first] + BLOCK_CHARS, "right")))
        for at in range(0, int(lengths[first]) if last == first + 1 else 1, BLOCK_CHARS):
            block = lines[first:last] if last > first + 1 else [lines[first][at : at + BLOCK_CHARS]]
            code = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), np.uint32)
            line = np.repeat(np.arange(len(block)), [len(x) for x in block])
            kinds[first:last] += np.bincount(line * 7 + classes[code], minlength=7 * len(block)).reshape(-1, 7)
        first = last
    return kinds


def _words(line: str) -> tuple[int, int]:
    """A line's words and distinct words."""
    if len(line) <= BLOCK_CHARS:
        words = line.split()
        return len(words), len(set(words))
    n, seen = 0, set()
    for m in WORD.finditer(line):
        n += 1
        seen.add(m.group())
    return n, len(seen)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all non-blank lines, their lengths in characters, and the number of lines per text."""
    lines: list[str] = []
    counts, repeats = [], []
    for text in texts:
        own = [x for x in (text or "").split("\n") if x and not x.isspace()]
        seen: set[str] = set()
        for x in own:
            repeats.append(x in seen)
            seen.add(x)
        lines += own
        counts.append(len(own))
    n = np.array(counts, np.int64)
    if not lines:
        return np.zeros((0, 3 * OWN + 3), np.float32), np.zeros(0), n
    lengths = np.array([len(x) for x in lines], np.int64)
    kinds = _kinds(lines, lengths)
    counted = [_words(x) for x in lines]
    words = np.array([n for n, _ in counted], np.float32).clip(1)
    distinct = np.array([n for _, n in counted], np.float32)
    marks = kinds[:, SYMBOL]
    letters = (kinds[:, LETTER] + kinds[:, UPPER]).clip(1)
    own_features = np.stack(
        [
            np.minimum(marks / words, 3) / 3,
            np.minimum(kinds[:, SHOUT] / words, 3) / 3,
            kinds[:, UPPER] / letters,
            kinds[:, DIGIT] / lengths,
            kinds[:, OTHER] / lengths,
            letters / lengths,
            np.minimum(letters / words, 20) / 20,
            1 - distinct / words,
            (distinct / words < 0.5) & (words >= 6),
            np.log1p(words) / 8,
            marks >= 0.3 * words,
            np.array(repeats, np.float32),
        ],
        axis=1,
    ).astype(np.float32)
    last = np.cumsum(n) - 1
    first = last - n + 1
    some = n > 0
    begins, ends = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    begins[first[some]], ends[last[some]] = True, True
    before = np.vstack([own_features[:1], own_features[:-1]]) * ~begins[:, None]
    after = np.vstack([own_features[1:], own_features[-1:]]) * ~ends[:, None]
    flags = np.stack([np.ones(len(lines)), begins, ends], axis=1).astype(np.float32)
    return np.hstack([own_features, before, after, flags]), lengths, n


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(good: np.ndarray, move: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line marginals, expected label pairs, and each text's log partition.

    ``good``: log odds of each line; ``move``: 2x2 log weights of neighbouring labels; ``n``: lines per
    text. All texts advance together, longest first, so a step is one operation on arrays.
    """
    order = np.argsort(-n, kind="stable")
    n_sorted = n[order]
    start = (np.cumsum(n) - n)[order]
    unary = np.stack([np.zeros(len(good)), good], axis=1)
    f, b = unary.copy(), np.zeros_like(unary)
    active = [int(np.searchsorted(-n_sorted, -t, side="left")) for t in range(int(n_sorted[0]) if len(n) else 0)]
    for t in range(1, len(active)):
        i = start[: active[t]] + t
        f[i] += _log_add(f[i - 1][:, :, None] + move, 1)
    for t in range(len(active) - 1, 0, -1):
        i = start[: active[t]] + t
        b[i - 1] = _log_add(move + (unary[i] + b[i])[:, None, :], 2)
    some = n > 0
    last = (np.cumsum(n) - 1)[some]
    z = np.zeros(len(n))
    z[some] = _log_add(f[last], 1)
    each = np.repeat(z, n)
    marginal = np.exp(f + b - each[:, None])[:, 1]
    begins = np.zeros(len(good), bool)
    begins[(np.cumsum(n) - n)[some]] = True
    later = np.flatnonzero(~begins)
    pairs = np.exp(f[later - 1][:, :, None] + move + (unary[later] + b[later])[:, None, :] - each[later][:, None, None])
    return marginal, pairs.sum(axis=0), z


class Field:
    """Weights of the line features and label pairs, and where the training texts divide."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, cut: float) -> None:
        self.weights, self.move, self.cut = weights, move, cut

    @property
    def known(self) -> bool:
        """Whether anything was learnt."""
        return bool(np.any(self.weights))

    def shares(self, x: np.ndarray, lengths: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The length-weighted mean marginal of each text; NaN without lines."""
        if not len(x):
            return np.full(len(n), np.nan)
        marginal, _, _ = forward_backward(x @ self.weights, self.move, n)
        text = np.repeat(np.arange(len(n)), n)
        with np.errstate(invalid="ignore"):
            return np.bincount(text, marginal * lengths, len(n)) / np.bincount(text, lengths, len(n))

    def scores(self, shares: np.ndarray) -> np.ndarray:
        bent = np.where(shares < self.cut, THRESHOLD * shares / self.cut, THRESHOLD + (1 - THRESHOLD) * (shares - self.cut) / (1 - self.cut))
        return np.where(np.isnan(bent), 0.5, bent).clip(0, 1)


def fit(x: np.ndarray, lengths: np.ndarray, n: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, decay: float = 1e-3) -> Field:
    """Fit by gradient ascent with per-weight steps; texts of either label weigh the same in all."""
    text = np.repeat(np.arange(len(n)), n)
    doc_good = labels[text] == 1
    target = doc_good.copy()
    share = np.where(doc_good, 0.5 / max(1, doc_good.sum()), 0.5 / max(1, (~doc_good).sum()))
    weight = share * len(x)
    begins = np.r_[True, text[1:] != text[:-1]]
    later = np.flatnonzero(~begins)
    for _ in range(rounds):
        theta = np.zeros(x.shape[1] + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (target[later - 1].astype(int), target[later].astype(int)), 1)
        for step in range(1, steps + 1):
            w, move = theta[:-4], theta[-4:].reshape(2, 2)
            marginal, expected, _ = forward_backward(x @ w, move, n)
            g = np.r_[(weight * (target - marginal)) @ x, (pairs - expected).ravel()] / len(x) - decay * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, move = theta[:-4], theta[-4:].reshape(2, 2)
        marginal, _, _ = forward_backward(x @ w, move, n)
        found = doc_good | (marginal > 0.5)
        all_good = np.bincount(text, found, len(n)) == n
        for k in np.flatnonzero(all_good & (labels == 0) & (n > 0)):
            found[np.flatnonzero(text == k)[marginal[text == k].argmin()]] = False
        if (found == target).all():
            break
        target = found
    field = Field(w, move, 0.5)
    shares = field.shares(x, lengths, n)
    some = ~np.isnan(shares)
    s, y = shares[some], labels[some]
    order = np.argsort(s)
    s, y = s[order], y[order]
    # The cut with the best mean of both labels' shares on their own side, in the middle of its gap.
    gain = np.r_[0, np.cumsum(np.where(y == 0, 1 / max(1, (y == 0).sum()), -1 / max(1, (y == 1).sum())))]
    k = int(gain.argmax())
    field.cut = float(np.clip((s[k - 1] + s[k]) / 2 if 0 < k < len(s) else 0.5, 0.02, 0.98))
    return field


def chains(n: int, text_lines: int = MAX_TEXT_LINES) -> list[tuple[int, int]]:
    """Where the chains of a text of ``n`` lines begin and end."""
    found = [(at, min(n, at + CHAIN_LINES)) for at in range(0, n, CHAIN_LINES)]
    most = max(2, text_lines // CHAIN_LINES)
    return found if n <= max(text_lines, most * CHAIN_LINES) else [found[k * (len(found) - 1) // (most - 1)] for k in range(most)]


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = MAX_TRAIN_LINES, text_lines: int = MAX_TEXT_LINES) -> Field:
    """Fit on a bounded sample of ``docs(doc_id, text)`` with ``labels(doc_id, quality)``, both already without held-out rows."""
    none = Field(np.zeros(3 * OWN + 3), np.zeros((2, 2)), 0.5)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    keyed = docs.filter(F.col("text").rlike(r"(?U)\S") & F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    # Narrow rows; what has no label goes before anything is counted.
    labelled = keyed.groupBy("doc_id", "key").agg(F.max(lines).cast("long").alias("lines")).join(known, "doc_id").select("key", "lines", "quality")
    labelled = materialize(labelled, "op4-labelled")
    totals = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    if len(totals) < 2:
        return none
    place = (F.shiftright("key", 11) + F.lit(2**52)) / F.lit(2.0**53)
    share = F.create_map(*[F.lit(x) for y, n in sorted(totals.items()) for x in (y, train_docs / n)])
    # About 2 * train_docs narrow rows, a bound that the input's size doesn't move.
    drawn: list[tuple[int, int]] = []
    taken = dict.fromkeys(totals, 0)
    for r in labelled.filter(place < share[F.col("quality")]).orderBy("key").collect():
        if taken[r["quality"]] < train_lines:
            taken[r["quality"]] += min(r["lines"], text_lines)
            drawn.append((r["key"], r["quality"]))

    @F.pandas_udf("struct<x:binary,lengths:binary,n:array<long>>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                x, lengths, n = line_features([t])
                parts = chains(int(n[0]), text_lines)
                at = np.concatenate([np.arange(a, b) for a, b in parts]) if parts else np.zeros(0, np.int64)
                rows.append((x[at].tobytes(), lengths[at].astype("<i8").tobytes(), [b - a for a, b in parts]))
            yield pd.DataFrame(rows, columns=["x", "lengths", "n"])

    sample = F.broadcast(small_table(docs.sparkSession, drawn, "key long, quality int"))
    own = keyed.join(sample, "key").groupBy("key", "quality").agg(F.first("text").alias("text"))
    rows = [r for r in own.select("key", "quality", described("text").alias("d")).orderBy("key").collect() if r["d"]["n"]]
    if len({r["quality"] for r in rows}) < 2:
        return none
    x = np.vstack([np.frombuffer(r["d"]["x"], np.float32).reshape(-1, 3 * OWN + 3) for r in rows])
    lengths = np.concatenate([np.frombuffer(r["d"]["lengths"], "<i8") for r in rows])
    n = np.array([n for r in rows for n in r["d"]["n"]], np.int64)
    y = np.array([r["quality"] for r in rows for _ in r["d"]["n"]])
    return fit(x, lengths, n, y)


def score(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    keep = others(docs, "score", "predicted")
    return scored(docs, keep, field, text_col).select(*unpack(keep), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def scored(docs: DataFrame, keep: list[str], field: Field, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` as a struct ``row`` beside ``score``."""
    known = field.known

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        for texts in batches:
            out, block, size = [], [], 0
            for t in [*texts, None]:
                block.append(t)
                size += len(t) if t else 0
                if size > BLOCK_CHARS or len(block) + len(out) > len(texts):
                    out += field.scores(field.shares(*line_features(block)) if known else np.full(len(block), np.nan)).tolist()
                    block, size = [], 0
            yield pd.Series(out[: len(texts)], dtype="float64")

    return pack(docs, keep, score=quality(named(text_col)))
