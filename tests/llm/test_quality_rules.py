import re
from collections import Counter

import pytest

from worldpulse.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


@pytest.fixture(scope="module")
def judged(spark, sf):
    return Q.apply(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().set_index("doc_id")


def test_measures(spark, sf, judged):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = judged.loc[r["doc_id"]]
        assert tuple(own[list(Q.MEASURES[:5])]) == plain(r["text"])
        n, *_, repeated = plain(r["text"])
        assert own["base_failed"] == (n < 50 or 100 * repeated > 50 * n)


def test_verdict_divides_labelled_texts(spark, judged):
    sf = "/root/testdata/sf0.01"
    found = Q.apply(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "base_failed", "kept").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    sound = found[~found.base_failed]
    assert sound[sound.quality == 0].kept.mean() < 0.05
    assert sound[sound.quality == 1].kept.mean() > 0.995
    assert not found[found.base_failed].kept.any()


def test_shared_hashes_don_t_matter(spark):
    text = " ".join(["a b c", "x", "a b c", "y", "a b d", "z", "a b d"])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert Q.measure(docs).first()["n_repeat_words"] == plain(text)[4] == 12


def test_edges(spark):
    good = " ".join(f"word{k} other{k} thing" for k in range(40))
    rows = [(1, None, "en", "s", "x"), (2, "", "en", "s", "x"), (3, " \n\t ", None, None, "x"), (4, "a b", "en", None, "x"), (5, good, "en", "s", "x"), (5, good, "en", "s", "x"), (6, good, None, None, "x"), (7, "w " * 60_000, "en", "s", "x"), (8, "é日" * 50_000, "en", "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    found = Q.apply(docs)
    assert found.count() == len(rows)
    state = {r["doc_id"]: r for r in found.collect()}
    for k, text, *_ in rows:
        assert tuple(state[k][c] for c in Q.MEASURES[:5]) == plain(text)
    assert state[5]["kept"] and state[6]["kept"] and not state[7]["kept"] and not state[1]["kept"]
    assert Q.apply(docs.limit(0)).count() == 0


def test_small_groups_use_larger_ones(spark):
    def text(k, symbols):
        return " ".join(f"w{k}x{i}" + "#" * (i < symbols) for i in range(100))

    rows = [(k, text(k, 0), "en", "big") for k in range(60)] + [(100, text(100, 0), "en", "small"), (101, text(101, 60), "en", "small")]
    rows += [(200 + k, text(200 + k, 30), "pl", "code") for k in range(60)]
    found = {r["doc_id"]: r["kept"] for r in Q.apply(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert found[100] and not found[101]
    # A source where symbols are usual keeps texts that another one rejects.
    assert found[200] and found[0]


def test_fences_are_those_of_exact_quantiles(spark):
    """Groups no larger than a sketch holds are kept whole in it, so fences and verdicts can be worked out by hand."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("length(text) < 20000")
    measured, _ = Q.measured_rows(docs)
    limits = Q.fences(measured).toPandas()
    rated = Q.ratios(measured.filter(~Q.base_failed())).select("lang", "source", *Q.SKETCHED).toPandas()

    def quantile(values, q):
        return np.sort(values)[max(0, int(np.ceil(q * len(values))) - 1)]

    groups = rated.groupby(["lang", "source"])
    for r in limits.to_dict("records"):
        own = groups.get_group((r["lang"], r["source"]))
        if len(own) < Q.MIN_GROUP:
            own = rated[rated.lang == r["lang"]]
        for name, size, events in Q.RULES:
            q1, q2, q3 = (quantile(own[name].to_numpy(), q) for q in (0.25, 0.5, 0.75))
            reach = Q.SPREAD * max(q3 - q1, Q.LEAST_RELATIVE * q2) if size is None else max(Q.SPREAD * (q3 - q1), events / max(1, quantile(own[size].to_numpy(), 0.5)))
            assert r[f"{name}_high"] == pytest.approx(q3 + reach, rel=1e-9), (r["lang"], r["source"], name)
            assert r[f"{name}_low"] == (pytest.approx(q1 - reach, rel=1e-9) if size is None else float("-inf"))
    assert limits.symbols_per_word_high.nunique() > 10 and limits.mean_word_chars_high.nunique() > 10


def test_own_columns_keep_their_values(spark):
    good = " ".join(f"word{k} other{k} thing" for k in range(40))
    own = {"_words": 1, "_keys": 2, "_found": 3, "words": 4, "keys": 5, "found": 6, "lines": 7, "row": 8, "symbols_per_word": 9, "symbols_per_word_low": 10, "fence_lang": 11, "a.b": 12, "of": 13}
    docs = spark.createDataFrame([(good, "en", "s", *own.values())], ["text", "lang", "source", *own])
    found = Q.apply(docs).first().asDict()
    assert {c: found[c] for c in own} == own and found["kept"] and found["n_words"] == 120
