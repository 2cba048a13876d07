import hashlib
import re

import pytest

from worldpulse.llm import decontamination as D
from worldpulse.llm.queries import op8_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window=13):
    own = words(text)
    hit, names = set(), set()
    for name, item in items:
        w = words(item)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            part = w[i : i + window]
            for k in range(len(own) - len(part) + 1):
                if own[k : k + len(part)] == part:
                    hit |= set(range(k, k + len(part)))
                    names.add(str(name))
    return len(own), len(hit), len(names), ",".join(sorted(names))


@pytest.fixture(scope="module")
def items(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]


def test_documents(spark, sf, items):
    found = {r["doc_id"]: r for r in op8_decontamination(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert any(r["contaminated"] for r in found.values())
    parts = {n: words(t) for n, t in items}
    for r in docs:
        text = " ".join(words(r["text"]))
        near = [(n, t) for n, t in items if any(" ".join(parts[n][i : i + 13]) in text for i in range(max(1, len(parts[n]) - 12)))]
        n, hit, names, listed = plain(r["text"], near)
        own = found[r["doc_id"]]
        assert (own["n_words"], own["n_hit"], own["n_items"]) == (n, hit, names)
        assert own["items_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert own["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_blocks_of_a_large_benchmark_are_united(spark, sf):
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = D.mark(docs, benchmark).select("doc_id", "marks").collect()
    many = D.mark(docs, benchmark, max_pattern_bytes=40_000).select("doc_id", "marks").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_spans_point_into_the_text(spark):
    item = " ".join(f"w{k}" for k in range(15))
    text = "Ünrelated — BEGIN " + item.upper().replace(" ", ", ") + "! The end of it."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, item), (6, "w3"), (None, "the END")], "item_id long, text string")
    marks = D.mark(docs, benchmark).first()["marks"]
    assert [text[s["start"] : s["end"]] for s in marks["spans"]] == [item.upper().replace(" ", ", ") + "! The end"]
    assert marks["items"] == ["", "5", "6"]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "...", "x"), (4, "a b c", "x"), (4, "a b c", "x"), (5, "a b c " * 40_000, "x"), (6, "d " * 59 + "a b", "x")], "doc_id long, text string, n_hit string")
    benchmark = spark.createDataFrame([(1, "A b"), (1, "a B!"), (2, None), (3, "--")], "item_id long, text string")
    for limit in (D.MAX_PATTERN_BYTES, 3):
        found = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in D.contamination(D.mark(docs, benchmark, max_pattern_bytes=limit)).collect())
        assert found == [(1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 3, 2, 1, True), (4, 3, 2, 1, True), (5, 120_000, 80_000, 1, True), (6, 61, 2, 1, False)]
    assert [r["doc_id"] for r in D.decontaminate(docs, benchmark).orderBy("doc_id").collect()] == [1, 2, 3, 6]
    assert D.decontaminate(docs, benchmark).columns == docs.columns
    assert D.contamination(D.mark(docs, benchmark.limit(0))).filter("n_hit > 0").count() == 0
    assert D.mark(docs.limit(0), benchmark).count() == 0


def test_a_full_bitmap_leaves_no_window_out(spark, sf):
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet").limit(80), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = D.mark(docs, benchmark).select("doc_id", "marks").collect()
    full = D.mark(docs, benchmark, max_pattern_bytes=100_000, most_bits=1 << 15).select("doc_id", "marks").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, full))


def test_own_columns_keep_their_values(spark):
    own = {"marks": 9, "items": 1, "n_hit": 2, "n_words": 3, "contaminated": "x", "row": 4, "at": 5, "_key": 6, "a.b": 7}
    docs = spark.createDataFrame([("nothing of it", *own.values())], ["text", *own])
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    kept = D.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.first() == docs.first()
    out = D.contamination(D.mark(docs, benchmark)).first().asDict()
    assert (out["n_hit"], out["n_words"], out["contaminated"], out["row"], out["at"], out["_key"], out["a.b"]) == (0, 3, False, 4, 5, 6, 7)
