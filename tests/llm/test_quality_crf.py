import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from worldpulse.llm import quality_crf as Q


def test_marginals_and_pairs_against_all_labellings():
    rng = np.random.default_rng(1)
    n = np.array([3, 0, 1, 4])
    good, move = rng.normal(size=n.sum()), rng.normal(size=(2, 2))
    marginal, pairs, z = Q.forward_backward(good, move, n)
    at, expected_pairs = 0, np.zeros((2, 2))
    for k, m in enumerate(n):
        weights = {}
        for y in itertools.product((0, 1), repeat=int(m)):
            weights[y] = np.exp(sum(good[at + i] for i in range(m) if y[i]) + sum(move[y[i], y[i + 1]] for i in range(m - 1)))
        total = sum(weights.values())
        for i in range(m):
            assert np.isclose(marginal[at + i], sum(w for y, w in weights.items() if y[i]) / total)
        for y, w in weights.items():
            for i in range(m - 1):
                expected_pairs[y[i], y[i + 1]] += w / total
        assert m == 0 or np.isclose(z[k], np.log(total))
        at += m
    assert np.allclose(pairs, expected_pairs)


def test_features_are_the_same_in_any_company():
    texts = ["one line\n\nand two ###\nand two ###", None, "x", "", "last!!"]
    x, lengths, n = Q.line_features(texts)
    assert n.tolist() == [3, 0, 1, 0, 1]
    alone = [Q.line_features([t]) for t in texts]
    assert np.allclose(x, np.vstack([a[0] for a in alone])) and lengths.tolist() == [v for a in alone for v in a[1].tolist()]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    field = Q.learn(docs.filter(fold != 2), labels.filter(fold != 2))
    found = Q.score(docs, field).join(labels, "doc_id").toPandas()
    held = found[[zlib.crc32(str(d).encode()) % 4 == 2 for d in found.doc_id]]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.93


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n ", 1), (4, "a line", 1), (4, "a line", 1), (5, "w\n" * 20_000, 1), (6, "### " * 20_000, 1), (None, "x", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    blank = Q.learn(docs, labels)
    assert {r["score"] for r in Q.score(docs, blank).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, quality int")
    field = Q.learn(docs, labels)
    found = {r["doc_id"]: r["score"] for r in Q.score(docs, field).collect()}
    assert found[1] == found[2] == found[3] == 0.5 and found[4] > found[6]
    assert all(0 <= v <= 1 for v in found.values())
    assert Q.score(docs, field).count() == 8
    assert Q.score(docs.limit(0), field).count() == 0
    assert Q.score(docs.limit(0), Q.learn(docs.limit(0), labels.limit(0))).count() == 0


def test_training_texts_are_drawn_from_the_join_at_any_length(spark):
    rows = [(k, ("a plain line of words\n" if k % 2 else "### $$$ ###\n") * (1_000 if k % 2 else 2_000)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Far more labels than documents, and no text of either label under 10,000 bytes.
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    field = Q.learn(docs, labels, train_docs=20)
    found = {r["doc_id"]: r["predicted"] for r in Q.score(docs, field).collect()}
    assert field.known and found == {k: k % 2 for k in range(20)}


def test_chains_cover_a_text_or_are_spread_over_it():
    assert Q.chains(0) == [] and Q.chains(1) == [(0, 1)]
    assert Q.chains(1_200) == [(0, 500), (500, 1_000), (1_000, 1_200)]
    long = Q.chains(1_000_001)
    assert len(set(long)) == 40 and long[0] == (0, 500) and long[-1] == (1_000_000, 1_000_001)


def test_blank_texts_leave_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, " "), (2, "\n"), (3, "\u2003")], "doc_id long, text string")
    assert not Q.learn(docs, spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")).known


def test_short_good_and_long_bad_texts_are_told_apart(spark):
    good = [(k, f"a short plain text about matter {k}\nand one more line of words") for k in range(20)]
    bad = [(100 + k, "\n".join(f"### $$$ {k} %%% ### &&& @@@ {i}" for i in range(900))) for k in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k, _ in good] + [(k, 0) for k, _ in bad], "doc_id long, quality int")
    assert min(len(t) for _, t in bad) > 20_000
    found = {r["doc_id"]: r["score"] for r in Q.score(docs, Q.learn(docs, labels)).collect()}
    assert max(found[k] for k, _ in bad) < 0.7 <= min(found[k] for k, _ in good)


def test_blocks_of_characters_don_t_change_features(monkeypatch):
    texts = ["ab cd\n## 12\n" * 7, "", "x" * 130 + " y y\nz", "\u2003Ä! ?\n" + "w w1 " * 40, "one"]
    whole = Q.line_features(texts)
    for size in (1, 7, 50, 200):
        monkeypatch.setattr(Q, "BLOCK_CHARS", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, Q.line_features(texts), strict=True))


def test_own_columns_keep_their_values(spark):
    docs = spark.createDataFrame([("a line", 1, 2, 3, 4)], ["text", "_score", "row", "a.b", "Score"])
    out = Q.score(docs, Q.Field(np.zeros(3 * Q.OWN + 3), np.zeros((2, 2)), 0.5)).first().asDict()
    assert [out[c] for c in ("_score", "row", "a.b", "score", "predicted")] == [1, 2, 3, 0.5, 0] and "Score" not in out
