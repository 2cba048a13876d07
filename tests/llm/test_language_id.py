import zlib

import numpy as np
from pyspark.sql import functions as F

from worldpulse.llm import language_id as L

TRAINING = {"en": b"the cat and the dog sat on the mat, and the cat ran " * 5, "de": "der Hund und die Katze saßen über der Matte ".encode() * 5}


def plain_tree(data, order):
    """For each order, context -> byte -> count."""
    tree = [{} for _ in range(order + 1)]
    for n in range(order + 1):
        for i in range(n, len(data)):
            seen = tree[n].setdefault(data[i - n : i], {})
            seen[data[i]] = seen.get(data[i], 0) + 1
    return tree


def plain_length(tree, data, order):
    total = 0.0
    for i, byte in enumerate(data):
        n = min(order, i)
        while True:
            if n < 0:
                total += 8
                break
            if seen := tree[n].get(data[i - n : i]):
                size = sum(seen.values()) + len(seen)
                if byte in seen:
                    total += np.log2(size / seen[byte])
                    break
                total += np.log2(size / len(seen))
            n -= 1
    return total


def test_code_lengths_are_exact():
    for order in (0, 1, 3):
        trees = L.ContextTrees(TRAINING, order)
        for text in ("", "t", "the", "der Katze", "zebra ßß the 日本 qqqq", "a" * 50):
            data = text.encode()
            expected = [plain_length(plain_tree(TRAINING[x], order), data, order) for x in trees.languages]
            assert np.allclose(trees.code_lengths(data), expected, atol=1e-8)


def test_blocks_don_t_change_the_sum(monkeypatch):
    trees = L.ContextTrees(TRAINING)
    data = b"the cat and the dog " * 40
    whole = trees.code_lengths(data)
    monkeypatch.setattr(L, "BLOCK", 7)
    assert np.allclose(trees.code_lengths(data), whole, atol=1e-8)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    found = L.identify(docs, L.learn(docs.filter(fold != 0))).toPandas()
    held = found[[zlib.crc32(str(d).encode()) % 5 == 0 for d in found.doc_id]]
    assert len(held) > 150 and (held.lang_pred == held.lang).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_training_is_bounded_and_repeatable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = L.learn(docs, train_bytes=5000), L.learn(docs.repartition(7), train_bytes=5000)
    assert one == two and all(len(v) == 5000 for v in one.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "x"), (2, "", "en", "x"), (3, "123 ###", "de", "x"), (4, "the cat", None, "x"), (4, "the cat", None, "x"), (5, "der Hund und " * 20_000, "de", "x"), (6, "the dog", "und", "x")], "doc_id long, text string, lang string, score string")
    training = L.learn(docs)
    assert set(training) == {"en", "de", "und"}
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(docs, TRAINING).collect()]
    assert len(found) == 7
    assert {p for d, p, _ in found if d < 4} == {"und"} and {p for d, p, _ in found if d == 4} == {"en"} and {p for d, p, _ in found if d == 5} == {"de"}
    assert {r["lang_pred"] for r in L.identify(docs, {}).collect()} == {"und"}
    assert L.learn(docs.limit(0)) == {} and L.identify(docs.limit(0), TRAINING).count() == 0


def test_training_text_is_filled_despite_copies_and_long_texts(spark):
    copies = [("the same old text " * 20, "en")] * 3_000 + [(f"text {k} of many words {k * k} " * 8, "en") for k in range(60)]
    long = [("der Hund und die Katze " * 100_000, "de")] + [(f"Satz {k} mit Wort {k * k} " * 4, "de") for k in range(400)]
    docs = spark.createDataFrame(copies + long, "text string, lang string")
    training = L.learn(docs, train_bytes=4_000)
    assert {x: len(v) for x, v in training.items()} == {"en": 4_000, "de": 4_000}
    assert training["de"].count(b"Hund") < 20


def test_pieces_are_spread_over_a_long_text(spark):
    text = "a" * 50_000 + "ü" * 50_000 + "z" * 50_000
    docs = spark.createDataFrame([(text, "en"), ("short", "de")], "text string, lang string")
    training = L.learn(docs, train_bytes=1_000)
    assert len(training["en"]) == 1_000 and all(x in training["en"].decode(errors="ignore") for x in "aüz")
    assert training["de"] == b"short\n"


def test_many_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"{letters[k % 26]}{letters[k // 26]}q {letters[k // 26]}{letters[k % 26]}z " * 40, f"l{k:03d}") for k in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    training = L.learn(docs, total_bytes=60_000)
    assert len(training) == 300 and all(len(v) == 200 for v in training.values())
    many = L.Identifier(training)
    assert len(many.trees) == -(-300 // L.LANGUAGE_BLOCK)
    for text, lang in rows[::37]:
        bits = np.concatenate([t.code_lengths(text.encode()) for t in many.trees])
        expected = [plain_length(plain_tree(training[x], 3), text.encode(), 3) for x in many.languages[::29]]
        assert np.allclose(bits[::29], expected) and many.predict(text)[0] == lang
    many_labels = spark.createDataFrame([(f"text {k}", f"x{k}") for k in range(1_500)], "text string, lang string")
    assert len(L.learn(many_labels)) == 1_500


def test_own_columns_keep_their_values(spark):
    docs = spark.createDataFrame([("the cat", 1, 2, 3, 4, 5)], ["text", "_found", "found", "row", "a.b", "Lang_Pred"])
    out = L.identify(docs, TRAINING).first().asDict()
    assert [out[c] for c in ("text", "_found", "found", "row", "a.b")] == ["the cat", 1, 2, 3, 4] and out["lang_pred"] == "en" and "Lang_Pred" not in out
