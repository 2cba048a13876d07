import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from worldpulse.llm import training_order as T

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = T.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    slots = T.permute(range(n), n)
    assert sorted(slots) == list(range(n))
    assert T.permute(slots, n, inverse=True) == list(range(n))
    assert n < 100 or np.mean(np.array(T.permute(range(n), n, key=7)) != slots) > 0.9


@pytest.mark.parametrize("n", [1, 3, 17, 1000, 2**40 + 1])
def test_spark_gives_the_same_slots(spark, n):
    numbers = list(range(min(n, 1000))) + [n - 1]
    found = spark.createDataFrame([(x,) for x in numbers], "x long").select("x", T.slot_of(F.col("x"), n).alias("slot"))
    assert {r["x"]: r["slot"] for r in found.collect()} == dict(zip(numbers, T.permute(numbers, n), strict=True))


def ordered(docs, length=100, shard_records=300, **more):
    numbered, total = T.numbered(docs, RANKS, public_tokenizers.PATTERN, SPECIAL, length)
    return T.in_order(numbered, total, length=length, shard_records=shard_records, **more), total


def test_shards_hold_every_token_and_can_be_resumed(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.createDataFrame([(-7, "a <|endoftext|> b<|endoftext|>", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    codes, total = T.numbered(docs, RANKS, public_tokenizers.PATTERN, SPECIAL, 100)
    folder = f"file://{tmp_path}/shards"
    rows = T.write_shards(codes, total, folder, shard_records=300, length=100, shards_per_partition=2).collect()
    assert sorted(r["slot"] for r in rows) == list(range(total))
    assert all(r["shard"] == r["slot"] // 300 and r["offset"] == r["slot"] % 300 * T.stride(100) for r in rows)
    files = {r["file"]: r for r in rows}
    assert len(files) == -(-total // 300) == len({r["shard"] for r in rows})
    for name, r in files.items():
        raw = (tmp_path / "shards" / name).read_bytes()
        own = [x for x in rows if x["shard"] == r["shard"]]
        assert len(raw) == r["file_bytes"] == len(own) * T.stride(100) and hashlib.sha256(raw).hexdigest() == r["file_sha256"]
    read = list(T.read_slots(folder, 0, total, shard_records=300, length=100))
    resumed = list(T.read_slots(folder, 450, total, shard_records=300, length=100))
    assert [x[:3] for x in read[450:]] == [x[:3] for x in resumed]
    assert [(r["doc_id"], r["seq"], r["n_tokens"]) for r in sorted(rows, key=lambda r: r["slot"])] == [(d, s, len(ids)) for _, d, s, ids in read]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = {}
    for _, doc, seq, ids in read:
        parts[doc, seq] = ids.tolist()
    for r in docs.collect():
        own = sum((parts[k] for k in sorted(k for k in parts if k[0] == r["doc_id"])), [])
        assert own == library.encode(r["text"], add_special_tokens=False).ids


def test_only_tokenising_runs_in_python(spark, sf):
    found, _ = ordered(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = found.withColumn("record", T.record(100))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "Pandas"))


def test_numbers_hold_with_several_files_to_a_task(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = sorted((r["doc_id"], r["seq"], r["slot"]) for r in ordered(docs)[0].collect())
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    try:
        found, total = ordered(docs)
        assert sorted((r["doc_id"], r["seq"], r["slot"]) for r in found.collect()) == expected and total == len(expected)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_same_slots_for_any_partitioning(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.limit(9).withColumn("doc_id", F.lit(None).cast("long")))
    found = [sorted((repr(r["doc_id"]), r["seq"], r["slot"], bytes(r["ids"])) for r in ordered(docs.repartition(n))[0].collect()) for n in (1, 5, 9)]
    assert found[0] == found[1] == found[2]


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a", 1), (3, "a", 1), (None, "b", 1), (4, "x y " * 50_000, 1)], "doc_id long, text string, slot int")
    out, _ = ordered(docs, length=64, shard_records=50)
    counts = {r["doc_id"]: (r["n"], r["t"]) for r in out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    assert set(counts) == {3, None, 4} and counts[3] == (2, 2) and counts[None] == (1, 1)
    empty, none = ordered(docs.limit(0))
    assert none == 0 and empty.count() == 0
    codes, total = T.numbered(docs.limit(0), RANKS, public_tokenizers.PATTERN, SPECIAL)
    assert T.write_shards(codes, total, f"file://{tmp_path}/none").count() == 0
    # A clashing name is another column; ids and texts alone count.
    other = ordered(docs.drop("slot"), length=64, shard_records=50)[0].collect()
    assert sorted(map(repr, other)) == sorted(map(repr, out.collect()))


def test_a_large_group_of_equal_rows_is_spread(spark):
    docs = spark.createDataFrame([(None, "one text for all of them")] * 3_000 + [(k, f"text {k}") for k in range(300)], "doc_id long, text string")
    numbered, total = T.numbered(docs.repartition(8), RANKS, public_tokenizers.PATTERN)
    assert total == 3_300 and sorted(r["start"] for r in numbered.select("start").collect()) == list(range(3_300))


def test_shards_are_written_in_waves(spark, tmp_path, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("words "), F.col("id").cast("string")).alias("text"))
    codes, total = T.numbered(docs, RANKS, public_tokenizers.PATTERN, SPECIAL, 100)
    asked, own = [], T.in_order
    monkeypatch.setattr(T, "in_order", lambda *a: asked.append(own(*a)) or asked[-1])
    rows = T.write_shards(codes, total, f"file://{tmp_path}/shards", shard_records=5, length=100, shards_per_partition=2).collect()
    slots = [[r["slot"] for r in wave.collect()] for wave in asked]
    assert slots == [list(range(20)), list(range(20, 40))] and sorted(r["slot"] for r in rows) == list(range(40))
