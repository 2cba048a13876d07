import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from worldpulse.llm.line_dedup import LineRuns, dedup
from worldpulse.plans.commits import Conflict

LOW = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def key(line):
    return line.strip(" \t\n\v\f\r").translate(LOW)


def plain(docs, least_chars, least_docs):
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(held[key(x)]) < least_docs or i == max(held[key(x)], key=lambda d: (d is not None, d or 0))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LINES = ["alpha", " Alpha\t", "ALPHA\x0b", "bé", "BÉ", "\x1cbé", "", "  ", "gamma delta", "x"]
texts = st.one_of(st.none(), st.lists(st.sampled_from(LINES), max_size=6).map("\n".join))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 12)), texts), max_size=25))
def test_same_lines_as_a_plain_pass(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted((tuple(r) for r in dedup(df, 2, 3, batches=3).collect()), key=repr)
    assert found == plain(docs, 2, 3)


def test_many_documents_in_any_number_of_batches(spark):
    rnd = random.Random(2)
    docs = [(k, "\n".join(rnd.choice([f"line {int(rnd.paretovariate(0.7))}", "in all of them", f"own {k}"]) for _ in range(rnd.randint(1, 12)))) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = plain(docs, 6, 5)
    for batches in (1, 2, 7):
        assert sorted((tuple(r) for r in dedup(df, 6, 5, batches=batches).collect()), key=repr) == expected


def entries(spark, *rows):
    return spark.createDataFrame([(d, k, -k) for d, k in rows], "doc_id long, h1 long, h2 long")


def state(runs, least=1):
    return sorted((r["h1"], r["n_docs"], r["holder"]) for r in runs.repeated(least).collect())


def test_runs_are_merged_by_level_and_a_batch_counts_once(spark, tmp_path):
    runs = LineRuns(spark, str(tmp_path / "a"), 3)
    sizes = []
    for k in range(6):
        runs.add(f"batch {k}", entries(spark, (100 - k, 1), (100 - k, 10 + k)))
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1]]
    runs.add("batch 5", entries(spark, (1, 1), (1, 99)))
    again = LineRuns.open(spark, str(tmp_path / "a"))
    assert again.batches == [f"batch {k}" for k in range(6)]
    assert state(again) == [(1, 6, 100), *[(10 + k, 1, 100 - k) for k in range(6)]]
    assert [len(level) for level in again.levels] == [0, 0, 1]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    one, two = LineRuns(spark, str(tmp_path / "b"), 3), LineRuns(spark, str(tmp_path / "b"), 3)
    one.add("x", entries(spark, (1, 1)))
    with pytest.raises(Conflict):
        two.add("y", entries(spark, (2, 1)))
    after = LineRuns.open(spark, str(tmp_path / "b"))
    after.add("y", entries(spark, (0, 1)))
    assert state(after) == [(1, 2, 1)]


def test_runs_are_merged_without_moving_them(spark, tmp_path):
    runs = LineRuns(spark, str(tmp_path / "c"), 3)
    runs.add("x", spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").alias("h1"), F.col("id").alias("h2")).repartition(4))
    a, b = (spark.table(runs.names()[0]).alias(x).hint("merge") for x in "ab")
    plan = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_edges(spark):
    docs = spark.createDataFrame([(k, "same line\n" * 3 + "own", "c", k) for k in range(3)] + [(9, None, "c", 1), (9, "", "c", 2)], "doc_id long, text string, kept string, h1 int")
    found = dedup(docs, 4, 3)
    assert found.columns == ["doc_id", "h1", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, found.collect())) == [(0, 0, 4, 3, "own"), (1, 1, 4, 3, "own"), (2, 2, 4, 0, "same line\n" * 3 + "own"), (9, 1, 1, 0, ""), (9, 2, 1, 0, "")]
    assert dedup(docs.limit(0)).count() == 0
