import hashlib
import math
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from worldpulse.llm import quality_crf, queries
from tests.llm.test_ngram_jaccard import plain_components
from tests.llm.test_decontamination import plain, words
from tests.llm.test_language_id import plain_length, plain_tree


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append((name, docs))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_each_stage_keeps_columns_and_drops_rows(stages):
    first = stages[0][1]
    for (_, before), (_, after) in zip(stages, stages[1:-1], strict=False):
        assert after.columns == first.columns and ids(after) <= ids(before)
    assert ids(stages[-1][1]) == ids(stages[-2][1])


def test_near_duplicates_leave_one_of_each_group(stages):
    before, after = stages[2][1], stages[3][1]
    names = plain_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == {c for _, c in names.values()}


def test_contaminated_documents_go(spark, sf, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = set()
    for r in stages[3][1].collect():
        text = " ".join(words(r["text"]))
        near = [(n, t) for n, t in items if any(" ".join(words(t)[i : i + 13]) in text for i in range(max(1, len(words(t)) - 12)))]
        n, hit, _, _ = plain(r["text"], near)
        if hit and 20 * hit >= n:
            gone.add(r["doc_id"])
    assert ids(stages[3][1]) - ids(stages[4][1]) == gone


def test_token_ids(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[4][1].collect()}
    for r in stages[5][1].collect():
        own = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["token_ids"]) == struct.pack(f"<{len(own)}I", *own) and r["n_tokens"] == len(own)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_good_labelled_documents_stay(spark, sf, stages):
    good = ids(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1"))
    kept = ids(stages[2][1]) & good
    assert len(kept) >= 0.97 * len(good & ids(stages[0][1]))
    bad = ids(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0"))
    assert len(ids(stages[2][1]) & bad) <= 0.15 * len(bad)


def test_run_gives_the_stages_rows(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert {(r["doc_id"], r["ids_sha256"]) for r in got.collect()} == {(r["doc_id"], r["ids_sha256"]) for r in stages[-1][1].collect()}


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_one_query_per_operator():
    names = [n for n in queries.queries() if n != "quoted_conversations"]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]


def test_nulls_repeats_and_long_texts(spark, sf):
    good = spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect()
    odd = [(None, None, None, None, None), (None, good[0]["text"] + " x", None, "s", 1), (5001, "", "en", None, 0), (5002, "1 2 3", "en", "s", 5), (5003, good[1]["text"], "en", "s", 1), (5003, good[1]["text"], "en", "s", 1), (5004, "long words in a very long line " * 20_000, "en", "s", 1)]
    docs = spark.createDataFrame([tuple(r) for r in good] + odd, spark.read.parquet(f"{sf}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "language_id":
            assert not {5001, 5002} & ids(docs) and {5003, 5004} <= ids(docs)
        if name == "near_duplicates":
            assert docs.filter("doc_id = 5003").count() <= 1
    assert docs.count() > 50


def test_all_documents_stay_without_a_quality_field(spark, sf, tmp_path):
    spark.createDataFrame([(-1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    with pytest.warns(UserWarning, match="all documents stay"):
        kept = corpus_pipeline.classify_quality(spark, docs, str(tmp_path))
    assert kept.count() == docs.count()


def test_own_columns_keep_their_values(spark, sf):
    own = {"score": "s", "lang_pred": "l", "predicted": 7, "found": 1, "marks": 2, "items": 3, "n_hit": 4, "contaminated": "c", "row": 5, "at": 6, "key": 8, "a.b": 9}
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 2 = 0")
    docs = spark.createDataFrame([(*r, *own.values()) for r in docs.collect()], docs.schema.simpleString()[7:-1].replace(":", " ") + ", score string, lang_pred string, predicted long, found long, marks long, items long, n_hit long, contaminated string, `row` long, `at` long, key long, `a.b` long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, sf)
        rows = after.collect()
        assert after.columns == docs.columns and len(rows) > 30, name
        assert all({c: r[c] for c in own} == own for r in rows), name
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.encode(spark, docs, sf).first().asDict()
    assert {c: last[c] for c in own} == own


def test_language_stage_against_plain_code_lengths(spark, stages):
    docs = spark.createDataFrame(stages[0][1].collect(), stages[0][1].schema)
    training = queries.language_training(docs)
    trees = {x: plain_tree(t, 3) for x, t in training.items()}
    kept = ids(stages[1][1])
    rows = [r for r in docs.collect() if len(r["text"] or "") < 1_500][:25]
    extra = [(-1, "#§$% 12 ~~"), (-2, "Ж" * 40)]
    for doc_id, text in [(r["doc_id"], r["text"]) for r in rows]:
        bits = min(plain_length(t, text.encode(), 3) for t in trees.values())
        assert (doc_id in kept) == (any(c.isalpha() for c in text) and bits < 8 * len(text.encode())), doc_id
    odd = spark.createDataFrame([(d, t, None, "s", len(t)) for d, t in extra] + [tuple(r) for r in docs.collect()], docs.schema)
    kept = ids(corpus_pipeline.identify_language(spark, odd, ""))
    for doc_id, text in extra:
        bits = min(plain_length(t, text.encode(), 3) for t in trees.values())
        assert (doc_id in kept) == (any(c.isalpha() for c in text) and bits < 8 * len(text.encode())), doc_id


def test_quality_stage_against_plain_marginals(spark, sf, stages):
    before = stages[1][1]
    field = queries.quality_field(before, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = ids(stages[2][1])
    for r in before.collect()[:80]:
        x, lengths, n = quality_crf.line_features([r["text"]])
        good = [math.exp(v) for v in x @ field.weights]
        move = [[math.exp(v) for v in row] for row in field.move]
        weight = lambda k, y: good[k] if y else 1.0
        forward, backward = [[weight(0, 0), weight(0, 1)]], [[1.0, 1.0]]
        for k in range(1, int(n[0])):
            own = [weight(k, y) * sum(forward[-1][p] * move[p][y] for p in (0, 1)) for y in (0, 1)]
            forward.append([v / sum(own) for v in own])
        for k in range(int(n[0]) - 1, 0, -1):
            own = [sum(move[y][q] * weight(k, q) * backward[0][q] for q in (0, 1)) for y in (0, 1)]
            backward.insert(0, [v / sum(own) for v in own])
        marginals = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward, strict=True)]
        share = sum(m * w for m, w in zip(marginals, lengths, strict=True)) / sum(lengths)
        assert abs(share - field.cut) < 1e-6 or (r["doc_id"] in kept) == (share >= field.cut), r["doc_id"]
