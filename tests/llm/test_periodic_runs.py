import hashlib
import random
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from worldpulse.llm import periodic_runs, queries
from worldpulse.llm.periodic_runs import collapse, find_runs


def plain(words, exponent, least):
    """Every period is tried at every place."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            smaller = any(all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q))
            if end - start >= max(least, exponent * q) and not smaller:
                found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


texts = st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=4)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(2, 7), st.sampled_from([1, 6, 9]))
def test_same_runs_as_trying_all_periods(texts, exponent, least):
    assert find_runs(texts, exponent, least) == [plain(t, exponent, least) for t in texts]


def test_planted_runs_of_long_texts():
    rnd = random.Random(5)
    for period in (1, 2, 7, 40):
        words = [b"%d" % rnd.randrange(30) for _ in range(900)]
        for i in range(300, 300 + 5 * period + period // 2):
            words[i] = words[300 + (i - 300) % period]
        assert find_runs([words], 4, 6) == [plain(words, 4, 6)]


@pytest.mark.parametrize("unit", [[b"a"], [b"a", b"b", b"c"]])
def test_one_text_that_is_a_single_run(unit):
    n = 60_000 // len(unit)
    assert find_runs([unit * n], 4, 6) == [[(0, n * len(unit), len(unit))]]


def test_collapse():
    words = b"x a b a b a b a b a y".split()
    runs = find_runs([words], 4, 6)[0]
    assert runs == [(1, 9, 2)]
    assert collapse(words, runs) == b"x a b y"


def test_edges(spark):
    rows = [(1, None, "p"), (2, "", "p"), (3, " \n\t ", None), (4, "go " * 6, "q"), (4, "go " * 6, "q"), (5, "a\x0bb\x1cb c", "q"), (None, "no " * 7, "q"), (6, "w " * 300_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.collapse_runs(docs).collect()), key=repr)
    assert found == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), *[(4, 6, [(0, 6, 1)], "go")] * 2, (5, 3, [], "a b\x1cb c"), (0, 7, [(0, 7, 1)], "no"), (6, 300_000, [(0, 300_000, 1)], "w")], key=repr
    )
    assert periodic_runs.collapse_runs(docs).columns == ["doc_id", *periodic_runs.OUTPUTS]
    kept = periodic_runs.collapse_runs(docs.withColumnRenamed("runs", "row")).filter("doc_id = 5").first()
    assert kept["row"] == "q"
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0


def test_the_query_against_plain_search(spark, sf):
    """Texts of up to 300 words, whose periods can all be tried."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op12_periodic_runs(spark, sf).collect()
    assert len(found) == len(docs)
    seen = 0
    for r in found:
        words = (docs[r["doc_id"]] or "").encode().split()
        n = len(words)
        if n > 300:
            continue
        h = crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain(words, 4, 6)
        seen += len(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *best, 1000 * best[1] // best[2] if runs else None)
        assert (r["runs_sha256"], r["collapsed_sha256"]) == (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapse(words, runs)).hexdigest())
    assert seen
