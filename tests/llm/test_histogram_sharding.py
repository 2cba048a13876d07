import zlib

import pytest
from pyspark.sql import functions as F

from worldpulse.llm import histogram_sharding as H
from worldpulse.llm.queries import op9_histogram_sharding


def spread(df, shards):
    out = df.toPandas()
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = out.groupby("shard")["size"].sum()
    assert set(out.shard) <= set(range(shards))
    return out, sizes


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    out, sizes = spread(op9_histogram_sharding(spark, sf), 40)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(out.doc_id) == set(texts) and len(out) == len(texts)
    for r in out.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert sizes.max() - sizes.min() <= 2 * out["size"].max()


@pytest.mark.parametrize("exact", [20_000, 50])
def test_shares_are_near_equal_with_a_hot_group(spark, monkeypatch, exact):
    monkeypatch.setattr(H, "EXACT_ROWS", exact)
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-5)).otherwise(F.xxhash64("id")).alias("group_key"), F.xxhash64("id", F.lit(1)).alias("row_key"), (F.col("id") % 50 + 1).alias("size"), "id")
    out, sizes = spread(H.shard(rows, 16, ["id"]), 16)
    share = out["size"].sum() / 16
    assert abs(sizes - share).max() < 0.02 * share
    # The order of keys is that of shard and slot.
    ordered = out.sort_values(["shard", "slot"])
    keys = list(zip(ordered.group_key, ordered.row_key, strict=True))
    assert keys == sorted(keys)


def test_groups_stay_whole_where_they_can(spark):
    rows = spark.range(40_000).select(F.xxhash64(F.floor(F.col("id") / 4)).alias("group_key"), F.xxhash64("id").alias("row_key"), F.lit(10).cast("long").alias("size"), "id")
    out, sizes = spread(H.shard(rows, 8, ["id"]), 8)
    assert out.groupby("group_key").shard.nunique().max() == 1
    assert abs(sizes - 50_000).max() < 0.02 * 50_000


def test_same_result_from_any_partitioning(spark):
    rows = spark.range(5_000).select(F.xxhash64(F.col("id") % 700).alias("group_key"), F.xxhash64("id").alias("row_key"), (F.col("id") % 9).alias("size"), "id")
    one, two = (H.shard(r, 5, ["id"]).select("id", "shard", "slot").collect() for r in (rows, rows.repartition(7)))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_edges(spark, tmp_path):
    schema = "group_key long, row_key long, size long, id long, shard string"
    big = 2**63 - 1
    rows = [(big, big, 5, 1, "x"), (big, big, 5, 2, "x"), (-big - 1, -big - 1, 5, 3, "x"), (0, 0, None, 4, "x"), (0, 0, 0, 5, "x")]
    out, _ = spread(H.shard(spark.createDataFrame(rows, schema), 3, ["id"]), 3)
    assert len(out) == 5 and out.set_index("id").shard[1] == out.set_index("id").shard[2]
    assert H.shard(spark.createDataFrame([], schema), 3, ["id"]).count() == 0
    out, _ = spread(H.shard(spark.createDataFrame([(1, 1, 0, 1, "x")], schema), 3, ["id"]), 3)
    assert out.shard.tolist() == [0]
    docs = spark.createDataFrame([(1, None, "en"), (1, None, "en"), (2, "", "en"), (None, "é" * 100_000, "en")], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out, _ = spread(op9_histogram_sharding(spark, str(tmp_path)), 40)
    assert sorted(out["size"]) == [16, 16, 16, 200_016] and sorted(out.text_crc32)[:3] == [0, 0, 0]


@pytest.mark.parametrize("per_task", [300, 5_000, 10**9])
def test_parts_don_t_change_the_result(spark, per_task):
    """Against all rows sorted in one place: shards are runs of that order, cut within tolerance or at the nearest border, and slots are places in them."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(-5)).when(F.col("id") % 7 == 0, F.lit(-4)).otherwise(F.xxhash64("id"))
    rows = spark.range(20_000).select(hot.alias("group_key"), F.xxhash64("id", F.lit(1)).alias("row_key"), (F.col("id") % 50 + 1).alias("size"), "id").repartition(5)
    out = H.shard(rows, 12, ["id"], rows_per_task=per_task).toPandas()
    sorted_rows = out.sort_values(["group_key", "row_key", "id"]).reset_index(drop=True)
    ends = sorted_rows["size"].cumsum()
    assert sorted_rows["shard"].is_monotonic_increasing and sorted_rows["shard"].nunique() == 12
    assert (sorted_rows.groupby("shard").cumcount() == sorted_rows.slot).all()
    share = ends.iloc[-1] / 12
    for k in range(1, 12):
        cut = sorted_rows[sorted_rows["shard"] < k]["size"].sum()
        assert abs(cut - k * share) <= max(H.TOLERANCE * share, abs(ends - k * share).min())


def test_parts_are_small_where_a_group_is_hot(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, F.lit(7)).otherwise(F.xxhash64("id")).alias("group_key"), F.xxhash64("id").alias("row_key"), F.lit(1).cast("long").alias("size"), F.lit(0).alias("shard"))
    parts, most = H._parts(rows, 1, 500)
    counts = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert max(counts) <= 1_000 and len(counts) <= most and sum(counts) == 20_000


def test_equal_rows_are_split(spark, tmp_path):
    spark.createDataFrame([(None, "the same text")] * 4_000 + [(k, f"text {k}") for k in range(2_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out, sizes = spread(op9_histogram_sharding(spark, str(tmp_path)), 40)
    assert len(out) == 6_000 and sizes.max() - sizes.min() <= 0.02 * sizes.mean() + 2 * out["size"].max()


def test_own_columns_keep_their_values(spark):
    own = {"cell": 1, "base": 2, "hot": 3, "part": 4, "start": 5, "tie": 6, "row": 7, "n": 8, "a.b": 9}
    rows = spark.createDataFrame([(1, 1, 5, 1, *own.values()), (2, 2, 5, 2, *own.values())], ["group_key", "row_key", "size", "id", *own])
    out = [r.asDict() for r in H.shard(rows, 2, ["id", "a.b"], rows_per_task=1).collect()]
    assert all({c: r[c] for c in own} == own for r in out) and sorted((r["id"], r["shard"], r["slot"]) for r in out) == [(1, 0, 0), (2, 1, 0)]
