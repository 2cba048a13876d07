import math
import random

import numpy as np

from worldpulse.llm import lexical_search
from worldpulse.llm.lexical_search import Best, build, search, search_shard, terms


def plain(docs, queries, k):
    """Every document is scored for every query."""
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_docs, n_terms = len(own), sum(len(t) for _, t in own)
    out = []
    for query, text in queries:
        found = []
        for i, t in own:
            score, m = 0, 50 + 50 * len(t) * n_docs // n_terms
            for term in set(terms(text)) & set(t):
                tf, df = t.count(term), sum(term in o for _, o in own)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score:
                found.append((-score, i is None, i or 0))
        out += [(query, rank, None if unknown else i, -score) for rank, (score, unknown, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms():
    assert terms("Ab_cD-9é ÀB\x00x\x85y z") == ["ab".encode(), b"cd", "9é".encode(), "Àb".encode(), "x\x85y z".encode()]
    assert terms(None) == terms("") == terms(" ._") == []


def test_same_ranks_as_scoring_everything(spark):
    rnd = random.Random(3)
    words = [f"w{int(rnd.paretovariate(0.6)) % 80}" for _ in range(4000)]
    docs = [(rnd.choice([k, k, k, None]) if k % 9 else k // 2, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 40])))) for k in range(300)]
    asked = [(q, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 12])))) for q in range(15)] + [(99, "nothing here"), (98, None), (97, ""), (3, "w1 W1 w2"), (None, "w3")]
    table, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "item_id long, text string")
    expected = plain(docs, asked, 7)
    for limit, block in ((300, 1 << 20), (1 << 20, 120)):
        index = build(table, shard_bytes=limit)
        assert rows(search(index, queries, k=7, block_bytes=block)) == expected


def test_other_lists_are_only_probed():
    """A rare term decides; of the frequent one's postings those of the few documents that can still win are read."""
    n = 10_000
    m = np.full(n, 100)
    rare = (9_000, 9_000, np.arange(20) * 400, np.ones(20, np.int64))
    common = (10, 10, np.arange(n), np.ones(n, np.int64))
    ids, known = np.arange(n), np.zeros(n, bool)
    for p in (rare, common):
        assert p[0] == p[1]
    bounds = [(w * (10**9 // (1000 + 2000)), w, d, t) for _, w, d, t in (rare, common)]
    best = Best(10)
    read = search_shard(bounds, m, ids, known, best)
    assert read <= 40
    assert best.order.tolist() == [400 * i for i in range(10)]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Fox", 1), (3, "fox", 1), (None, "fox", 1), (4, "fox " + "hen " * 200_000, 2)], "doc_id long, text string, score int")
    queries = spark.createDataFrame([(1, "FOX!", "x")], "item_id long, text string, rank string")
    found = search(build(docs), queries)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = [tuple(r)[:3] for r in found.orderBy("rank").collect()]
    assert got == [(1, 1, 3), (1, 2, 3), (1, 3, None), (1, 4, 4)]
    assert search(build(docs.limit(0)), queries).count() == 0
    assert search(build(docs), queries.limit(0)).count() == 0
    assert lexical_search.build(docs.filter("doc_id < 3")).count() == 0
