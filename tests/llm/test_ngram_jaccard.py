import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from worldpulse.llm import ngram_jaccard as N
from worldpulse.llm.components import components
from worldpulse.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_components(rows):
    sets = {d: plain_set(t) for d, t in rows}
    lists = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            lists[x].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, s in sets.items():
        met = Counter(o for x in s for o in lists[x] if o < d)
        for o, k in met.items():
            if 100 * k >= 75 * (len(s) + len(sets[o]) - k):
                a, b = sorted((find(o), find(d)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def found(docs, **more):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.join(docs, **more).collect()}


def test_shingles_are_those_of_the_words():
    texts = ["", None, "a", "A b\tc\x0bd e f", "a b c d e f a b c d e f", "averyveryverylongword " * 9, "é ü\xa0ß 日 本 語", "x\ny"]
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    for s, t in zip(sets, texts, strict=True):
        assert np.array_equal(s, shingle_sets([t])[0])
    assert np.array_equal(shingle_sets(["A B"])[0], shingle_sets(["a\tb "])[0]) and not np.array_equal(shingle_sets(["ab"])[0], shingle_sets(["a b"])[0])


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert found(docs) == plain_components([tuple(r) for r in docs.collect()])


def test_groups_of_near_copies(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    rows = []
    for group in range(6):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((8, 60, 200)))] + passage * (group % 2)
        for _ in range(60):
            own = list(base)
            for _ in range(rnd.choice((0, 1, 2, 4, 8))):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            own = own[: len(own) - rnd.choice((0, 0, 3, 20))]
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == plain_components(rows)
    assert found(docs.repartition(9)) == plain_components(rows)
    # Lists dealt by set from a length of six on.
    assert found(docs.coalesce(2), long_list=6) == plain_components(rows)


def test_edges(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "a b", 0), (9, "A  b", 0), (6, long, 0), (7, long + " more", 0), (8, "lonely words here", 0), (8, "lonely words here", 0), (10, "b a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    state = found(docs)
    assert {d: c for d, (_, c) in state.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 9: 4, 6: 6, 7: 6, 8: 8, 10: 10}
    assert state[1][0] == 0 and state[4][0] == 1
    assert N.join(docs).count() == len(rows)
    kept = N.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 8, 10] and kept.columns == docs.columns
    unknown = spark.createDataFrame([(None, "x y z"), (None, None), (5, "x y z")], "doc_id long, text string")
    assert sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in N.join(unknown).collect()) == [("5", "5"), ("None", "5"), ("None", "None")]
    assert N.join(docs.limit(0)).count() == 0 and N.keep_one(docs.limit(0)).count() == 0


def test_one_row_stays_however_scans_are_split(spark, tmp_path):
    """Rows are found again by their place in the files, also where the second scan has other partitions than the first."""
    rows = [(k % 40, f"copy number {k % 20} of some text that comes again and again") for k in range(200)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        kept = N.keep_one(spark.read.parquet(path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
        assert sorted(map(tuple, kept.collect())) == sorted(rows[:20])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7), (40, 0)]
    out = {r["v"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    hub = 5_000
    star = [(hub, k) for k in range(1_000, 9_000) if k != hub] + [(k, k + 1) for k in range(20_000, 23_000, 2)]
    out = {r["v"]: r["component"] for r in components(spark.createDataFrame(star, "a long, b long").repartition(5)).collect()}
    assert out == {**{k: 1_000 for k in range(1_000, 9_000)}, **{k: k - k % 2 for k in range(20_000, 23_000)}}


def test_no_unlinked_row_is_lost(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "quite another text of seven words here", "and a third one that is alone too")
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "z"), (None, a, "n"), (None, c, "m"), (None, c, "m"), (None, None, "e"), (2, "", "e"), (2, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = N.keep_one(docs)
    got = sorted((repr(r["doc_id"]), repr(r["text"])) for r in kept.collect())
    assert got == sorted([("1", repr(a)), ("1", repr(b)), ("None", repr(c)), ("None", "None"), ("2", "''"), ("2", "None")])
    assert kept.columns == docs.columns and {r["row"] for r in kept.filter("text like 'quite%'").collect()} == {"y"}


def test_sets_that_share_a_name_are_told_apart(spark, monkeypatch):
    rows = [(k, f"word{k} some other words that follow number {k} here") for k in range(12)] + [(20, "word3 some other words that follow number 3 here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [t for _, t in rows[:2]]
    one, two = shingle_sets(texts)
    assert N._identity(one) != N._identity(two)
    clash = frozenset([N._identity(one)])
    assert N._identity(one, clash) == N._hash(one, 1) and N._identity(two, clash) == N._identity(two)
    assert found(docs) == plain_components(rows)


def test_hot_keys_join_once(spark):
    from worldpulse.llm.shared import hot_join

    many = spark.createDataFrame([(1, k) for k in range(500)] + [(k, k) for k in range(2, 300)], "k long, x long")
    one = spark.createDataFrame([(k, f"n{k}") for k in range(0, 250)], "k long, name string")
    got = sorted(map(tuple, hot_join(many, one, "k", share=10).collect()))
    assert got == sorted((k, x, f"n{k}") for k, x in [(1, j) for j in range(500)] + [(j, j) for j in range(2, 250)])


def test_overlaps_derived_from_models(spark):
    """Groups of similar sets around hubs that overlap with each other to all degrees; bounds must never be wrong, and decide much."""
    rnd = random.Random(11)
    hubs = {1: set(range(100)), 2: set(range(20, 120)), 3: set(range(8, 108)), 4: set(range(60, 160))}
    sets, star = dict(hubs), []
    for k in range(10, 90):
        hub = 1 + k % 4
        own = set(rnd.sample(sorted(hubs[hub]), 100 - rnd.randint(0, 8))) | {1_000 * k + i for i in range(rnd.randint(0, 8))}
        sets[k] = own
        star.append((min(hub, k), max(hub, k)))
    sets[200] = set(range(5, 95))

    def row(a, b):
        return (a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b]))

    links = spark.createDataFrame([row(a, b) for a, b in star], "a long, b long, na int, nb int, overlap int")
    links.write.mode("overwrite").format("noop").save()
    pairs = [row(a, b) for a in sets for b in sets if a < b and (a, b) not in star and (a == 200 or b == 200 or a % 4 != b % 4)]
    asked = spark.createDataFrame([p[:4] for p in pairs], "a long, b long, na int, nb int")
    wanted = spark.createDataFrame([(k,) for k in sets], "v long")
    of = {r["v"]: (r["model"], r["plus"], r["minus"]) for r in N.models(links, wanted).collect()}
    assert all(of[k] == (1 + k % 4, len(sets[k] - hubs[1 + k % 4]), len(hubs[1 + k % 4] - sets[k])) for k in range(10, 90)) and of[200] == (200, 0, 0)
    placed = N.with_models(asked, N.models(links, wanted))
    known = spark.createDataFrame([(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b], "low long, high long, overlap int")
    told = {(r["a"], r["b"]): r["verdict"] for r in N.judged(placed, known).collect()}
    truth = {(a, b): 7 * o >= 3 * (na + nb) for a, b, na, nb, o in pairs}
    assert set(told) == set(truth) and all(v is None or v == truth[k] for k, v in told.items())
    decided = Counter(told.values())
    assert decided[True] > 50 and decided[False] > 500 and decided[None] < len(pairs) / 2


def test_few_and_many_edges_give_the_same_components(spark):
    rnd = random.Random(4)
    edges = spark.createDataFrame([(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)], "a long, b long")
    assert sorted(map(tuple, components(edges, few=0).collect())) == sorted(map(tuple, components(edges).collect()))
