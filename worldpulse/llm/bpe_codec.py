"""Operator 3, byte-pair encoding and decoding with forced-boundary splitting.

A pair of bytes that is adjacent inside no vocabulary token can never be joined by a merge, so the
text is certain to be cut between them. The operator collects the pairs that do occur inside tokens,
cuts every pre-token at all other pairs, encodes the short fragments independently (each distinct one
once per Python process, in a table of bounded size) and concatenates their ids. Merges never cross
a certain cut and don't see what lies beyond it, so the result equals the encoding of the whole text.
Pre-tokens are found on the whole text first, because their pattern looks past a cut.

Nulls count as empty text: no ids. A text with added-token strings gets their ids, as the library's
default does. Repeated rows keep a row each, rows have no order in which ties could matter, an empty table gives
no rows. Very long texts are coded whole, and decoded in blocks. Extra columns pass through under any name; one
named like an output is replaced by it.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldpulse.llm.shared import named, one_per_process, others, pack, unpack
from worldpulse.llm.vocabulary import Vocabulary

MAX_PIECES = 150_000


def little_endian(ids) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class Codec:
    def __init__(self, vocab: Vocabulary, max_pieces: int = MAX_PIECES) -> None:
        self.vocab, self.max_pieces = vocab, max_pieces
        inside = np.zeros(65_536, bool)
        for b in vocab.id_of:
            for i in range(len(b) - 1):
                inside[b[i] << 8 | b[i + 1]] = True
        self.certain_cut = ~inside
        # Two generations: a full table becomes the old one, and what is still in use moves back.
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}
        self.lengths = np.array([len(b) for b in vocab.bytes_of], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(vocab.bytes_of), np.uint8)

    def split(self, piece: bytes) -> list[bytes]:
        """The fragments of one pre-token between its certain cuts."""
        if len(piece) < 2:
            return [piece]
        b = np.frombuffer(piece, np.uint8).astype(np.int32) if len(piece) > 256 else None
        if b is not None:
            cuts = (np.flatnonzero(self.certain_cut[b[:-1] << 8 | b[1:]]) + 1).tolist()
        else:
            certain = self.certain_cut
            cuts = [i for i in range(1, len(piece)) if certain[piece[i - 1] << 8 | piece[i]]]
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)], strict=True)]

    def fragment(self, b: bytes) -> bytes:
        known = self.fragments.get(b)
        if known is None:
            known = little_endian(self.vocab.merge(b))
            if len(b) <= 64:
                if len(self.fragments) >= self.max_pieces:
                    self.fragments.clear()
                self.fragments[b] = known
        return known

    def piece(self, text: str) -> bytes:
        ids = self.old.get(text) or b"".join(map(self.fragment, self.split(text.encode())))
        if len(text) <= 64:
            if len(self.pieces) >= self.max_pieces:
                self.old = dict(self.pieces)
                self.pieces.clear()
            self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        get, piece = self.pieces.get, self.piece
        for part in self.vocab.parts(text):
            if isinstance(part, int):
                out.append(little_endian([part]))
            else:
                out += [get(p) or piece(p) for p in self.vocab.pattern.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes, block: int = 1 << 20) -> str:
        """The text of the ids; bytes that aren't UTF-8 become U+FFFD. Works in blocks, so memory follows the text."""
        out = []
        for at in range(0, len(ids), 4 * block):
            k = np.frombuffer(ids[at : at + 4 * block], "<u4")
            n = self.lengths[k]
            ends = np.cumsum(n)
            out.append(self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[k] - ends + n, n)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def codec(raw: str) -> Codec:
    """One per Python process and vocabulary."""
    return one_per_process(("codec", raw), lambda: Codec(Vocabulary(raw)))


def _broadcast(df: DataFrame, vocab_path: str):
    with open(vocab_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``df`` with a binary column of its text's ids (little-endian unsigned 32-bit)."""
    raw = _broadcast(df, vocab_path)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(raw.value)
        for texts in batches:
            yield pd.Series([c.encode(t) for t in texts], dtype=object)

    return df.withColumn(out_col, ids(F.coalesce(named(text_col), F.lit(""))))


def decode(df: DataFrame, vocab_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text that its ids stand for."""
    raw = _broadcast(df, vocab_path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(raw.value)
        for rows in batches:
            yield pd.Series([c.decode(b) for b in rows], dtype=object)

    return df.withColumn(out_col, text(F.coalesce(named(ids_col), F.lit(b""))))


def round_trip(df: DataFrame, vocab_path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``df`` without its text but with ``n_tokens`` and digests of its ids and of the text decoded from them.

    Equal to hashing the columns of :func:`encode` and :func:`decode`, in one pass that keeps no decoded
    text beyond one document, and the ids only if ``token_ids`` is asked for.
    """
    raw = _broadcast(df, vocab_path)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids]

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string" + ",token_ids:binary" * with_ids + ">")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(raw.value)
        for texts in batches:
            rows = []
            for t in texts:
                ids = c.encode(t)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest())
                rows.append((*row, ids) if with_ids else row)
            yield pd.DataFrame(rows, columns=names)

    keep = others(df, text_col, *names)
    return pack(df, keep, digests=digests(F.coalesce(named(text_col), F.lit("")))).select(*unpack(keep), "digests.*")
