import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from worldpulse.llm import token_counts as T
from worldpulse.llm.token_counts import CountTransducer, count_tokens
from worldpulse.llm.vocabulary import Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*"ab 'srtlemvd1!\n\t", "\x1c", "\x85", "\xa0", " ", "　", "é", "ñ", "日", "😀", "<|endoftext|>", "<|endof", "²", "́", "\r", "\x00", "﻿"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return CountTransducer(Vocabulary(open(PATH, encoding="utf-8").read()))


def maps(machine, text, size, look=T.LOOK):
    return [machine.state_map(text[max(0, i - look) : i], text[i : i + size], text[i + size : i + size + T.AHEAD], i <= look) for i in range(0, len(text), size)] or [machine.state_map("", "", "", True)]


def test_chunks_compose_to_the_library_s_count(library, machine):
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30)))
        assert machine.fold(maps(machine, text, rnd.randint(1, 7))) == len(library.encode(text, add_special_tokens=False).ids), text


def test_chunks_that_know_little_compose_too(library, machine):
    rnd = random.Random(6)
    kinds = ["a", "ab", "=", "日本語の長い文", "é", " ", "\n ", "1", "QUJDRA", "lorem", "''s'", "x" * 40 + " "]
    certain = open_ = 0
    for k in range(150):
        kind = rnd.choice(kinds)
        text = "".join(rnd.choice(kind) for _ in range(rnd.randint(100, 700))) if k % 2 else kind * rnd.randint(20, 500)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(text))
            text = text[:at] + rnd.choice([*ODD, "<|endoftext|>", "'s"]) + text[at:]
        found = maps(machine, text, rnd.randint(20, 130), look=T.DOUBTFUL + rnd.randint(1, 60))
        assert machine.fold(found) == len(library.encode(text, add_special_tokens=False).ids), text
        certain += sum(m.rest is None for m in found)
        open_ += sum(m.rest is not None and len(m.table) > 1 for m in found)
    assert certain > 500 and open_ > 20


def test_unbroken_text_leaves_certain_maps(library, machine):
    text = "".join(random.Random(2).choice("日本語中文字的一是在不了有和人這") for _ in range(30_000))
    found = maps(machine, text, 5_000)
    assert all(m.rest is None and len(m.table) == 1 for m in found)
    assert machine.fold(found) == len(library.encode(text, add_special_tokens=False).ids)


def test_composition_is_associative(library, machine):
    text = "a" * 700 + "日本" * 200 + " some words " * 20
    found = maps(machine, text, 90, look=70)
    level = [(m.table, [m]) for m in found]
    one = level[0]
    for x in level[1:]:
        one = machine._compose(one, x)
    other = level[-1]
    for x in level[-2::-1]:
        other = machine._compose(x, other)
    assert one[0][""][1] == other[0][""][1] == machine.fold(found) == len(library.encode(text, add_special_tokens=False).ids)


def test_tables_stay_bounded(library):
    small = CountTransducer(Vocabulary(open(PATH, encoding="utf-8").read()), max_transitions=50, max_words=5)
    text = "some words that fill a very small table again and again, wordsthatneverend"
    assert small.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(small.words) <= 5 and len(small.arcs) <= 200


def test_counts_of_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    expected = {r["doc_id"]: (len(r["text"].encode()), len(library.encode(r["text"], add_special_tokens=False).ids)) for r in docs.collect()}
    for chunk in (65_536, 200):
        found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in count_tokens(docs, PATH, chunk_chars=chunk).collect()}
        assert found == expected


def test_edges(spark, library):
    long = "ab" * 40_000
    unbroken = "日本語中文字的一是在不了有和人" * 500
    rows = [(6, unbroken, "x"), (7, "<|endoftext|>" * 300, "x"), (8, " " * 5_000 + "x", "x"), (9, "=" * 3_000, "x"), (1, None, "x"), (2, "", "x"), (3, "a", "x"), (3, "a", "x"), (None, "b " * 300, None), (5, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in count_tokens(docs, PATH, chunk_chars=100).collect())
    expected = sorted((repr(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert found == expected
    assert count_tokens(docs.limit(0), PATH).count() == 0
