import hashlib
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from worldpulse.llm import bpe_codec
from worldpulse.llm.vocabulary import Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*"ab 'srtlemvd1!\n\t", "\x1c", "\x85", "\xa0", " ", "é", "ñ", "日", "😀", "<|endoftext|>", "<|endof", "́", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(b):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


def test_same_ids_and_text_as_the_library(library):
    codec = bpe_codec.Codec(Vocabulary(open(PATH, encoding="utf-8").read()), max_pieces=100)
    rnd = random.Random(6)
    for _ in range(3000):
        text = "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30)))
        expected = library.encode(text, add_special_tokens=False).ids
        ids = codec.encode(text)
        assert ids_of(ids) == expected, text
        assert codec.decode(ids) == library.decode(expected, skip_special_tokens=False)
        assert codec.decode(ids, block=3) == codec.decode(ids)


def test_cuts_are_where_no_token_has_the_pair():
    vocab = Vocabulary(open(PATH, encoding="utf-8").read())
    codec = bpe_codec.Codec(vocab)
    for piece in ("hello", "xqzj" * 100, "étéñ", "a"):
        parts = codec.split(piece.encode())
        assert b"".join(parts) == piece.encode()
        for left, right in zip(parts, parts[1:], strict=False):
            pair = left[-1:] + right[:1]
            assert not any(pair in b for b in vocab.id_of)


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r for r in bpe_codec.round_trip(docs, PATH, with_ids=True).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        own = found[r["doc_id"]]
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (own["n_tokens"], own["ids_sha256"], bytes(own["token_ids"])) == (len(ids), hashlib.sha256(raw).hexdigest(), raw)
        assert own["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "same", 5), (3, "same", 5), (4, "x" * 100_000, 5)], "doc_id long, text string, n_tokens int")
    back = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH)
    assert back.filter(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert back.count() == 5
    assert bpe_codec.round_trip(docs, PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe_codec.round_trip(docs.limit(0), PATH).count() == 0
