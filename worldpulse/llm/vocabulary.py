"""A byte-level BPE vocabulary as plain tables, and the cached lookups that tasks build from it."""

from __future__ import annotations

import heapq
import json

import regex

#: The pre-token pattern that the byte-level pre-tokenizer applies when ``use_regex`` is set.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces up to so many bytes are merged on plain lists.
SHORT = 64
NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as character -> byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in plain}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return table


class Vocabulary:
    """Token bytes, merge ranks and added tokens of one ``tokenizers`` file.

    Only the shape that the operators can honour exactly is accepted: byte-level BPE with the
    standard pattern, no normalizer, no prefix space and added tokens that match literally.
    """

    def __init__(self, raw: str) -> None:
        spec = json.loads(raw)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        to_byte = byte_alphabet()
        names = model["vocab"]
        self.added = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens must match literally")
            self.added[t["content"]] = t["id"]
        self.size = 1 + max([*names.values(), *self.added.values()])
        self.bytes_of: list[bytes] = [b""] * self.size
        for name, i in names.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in name) if all(c in to_byte for c in name) else name.encode()
        for name, i in self.added.items():
            self.bytes_of[i] = name.encode()
        special = set(self.added.values())
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if b and i not in special}
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        # Both ids of a pair in one number -> its rank and the merged id in one number, so the least is the next merge.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[names[left] << 32 | names[right]] = rank << 32 | names[left + right]
        self.pattern = regex.compile(PRETOKEN)
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece by the merge rules: the lowest rank first, leftmost first."""
        ids = [self.byte_ids[b] for b in piece]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        known = self.merges.get
        ranks = [known(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            ids[i] = least & 0xFFFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = known(ids[i - 1] << 32 | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = known(ids[i] << 32 | ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with linked positions and a heap: n log n, so a text without any pre-token boundary stays affordable."""
        n, known = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := known(ids[i] << 32 | ids[i + 1], NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = m & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := known(ids[i] << 32 | ids[k], NEVER)) < NEVER:
                    heapq.heappush(heap, (m, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := known(ids[h] << 32 | ids[i], NEVER)) < NEVER:
                heapq.heappush(heap, (m, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def parts(self, text: str):
        """``text`` cut at added tokens: strings to pre-tokenize, and ids for the added tokens between them."""
        if self.special is None or not any(x in text for x in self.added):
            yield text
            return
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()]
            yield self.added[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:]
