import random

import duckdb
import pytest

from pyspark.sql import functions as F

from worldpulse.llm import quotation_links as Q
from worldpulse.llm.queries import OP6_SQL, op6_quotation_links
from worldpulse.llm.shared import hot_join

SCHEMA = "conv_id long, turn long, role string, text string"


def link(spark, *rows):
    return {(r["conv_id"], r["turn"], r["body"]): r for r in Q.link(spark.createDataFrame(list(rows), SCHEMA)).collect()}


def test_replies_follow_nested_quotes(spark):
    found = link(
        spark,
        (1, 0, "a", "Hello there my friends.\nSecond line of the text is here."),
        (1, 1, "b", "On Monday a wrote:\n> Hello there, my   FRIENDS\n> Second line of the text is here.\nI agree with that."),
        (1, 2, "a", ">> Hello there my friends.\n> I agree with that.\nThank you, all the best."),
        (1, 3, "c", "> Second line of the text is here.\nOnly a line of it."),
        (2, 0, "a", "> nothing like this anywhere at all\nfoo"),
        (2, 1, "b", ">thank you all the best\nyes"),
    )
    state = {k[:2]: (k[2], r["n_quotes"], r["max_level"], r["reply_conv"], r["reply_turn"], r["thread_conv"], r["thread_turn"], r["depth"]) for k, r in found.items()}
    assert state[1, 0] == ("Hello there my friends.\nSecond line of the text is here.", 0, 0, None, None, 1, 0, 0)
    assert state[1, 1] == ("I agree with that.", 1, 1, 1, 0, 1, 0, 1)
    assert state[1, 2] == ("Thank you, all the best.", 2, 2, 1, 1, 1, 0, 2)
    assert state[1, 3] == ("Only a line of it.", 1, 1, 1, 0, 1, 0, 1)
    assert state[2, 0] == ("foo", 1, 1, None, None, 2, 0, 0)
    assert state[2, 1] == ("yes", 1, 1, 1, 2, 1, 0, 3)


def test_rows_come_in_reply_order(spark):
    rows = [(5, k, "a", f"message number {k}" if k == 0 else f"> message number {k - 1}\nmessage number {k}") for k in range(20)] + [(4, 0, "a", "alone")]
    df = Q.link(spark.createDataFrame(rows[::-1], SCHEMA))
    got = sorted((r["thread_conv"], r["thread_turn"], r["position"], r["conv_id"], r["turn"], r["depth"]) for r in df.collect())
    assert got == [(4, 0, 0, 4, 0, 0)] + [(5, 0, k, 5, k, k) for k in range(20)]
    parts = {(r["thread_conv"], r["segment"]): [(t["turn"], t["body"]) for t in r["turns"]] for r in Q.conversations(df, segment=8).collect()}
    assert parts == {(4, 0): [(0, "alone")], **{(5, k): [(i, f"message number {i}") for i in range(8 * k, min(20, 8 * k + 8))] for k in range(3)}}


def test_short_lines_and_rewrapped_paragraphs_find_their_message(spark):
    rows = [
        (1, 0, "a", "ok, ship it\nand then rest"),
        (1, 1, "b", "First paragraph, on\ntwo lines.\n\nSecond one.\n\nThird and last."),
        (1, 2, "c", "> ok, ship it\nshipped"),
        (1, 3, "a", "> First\n> paragraph, on two\n> lines.\n>\n> Second one.\nagreed"),
        (2, 0, "d", "> ok, ship it\nnot said here"),
    ]
    found = link(spark, *rows)
    assert found[1, 2, "shipped"]["reply_turn"] == 0 and found[1, 3, "agreed"]["reply_turn"] == 1
    assert (found[2, 0, "not said here"]["reply_conv"], found[2, 0, "not said here"]["reply_turn"]) == (1, 0)
    # A bound for other conversations is the caller's choice.
    bounded = {r["body"]: r["reply_conv"] for r in Q.link(spark.createDataFrame(rows, SCHEMA), least_far=12).collect()}
    assert bounded["not said here"] is None and bounded["shipped"] == 1


def test_a_third_of_all_messages_reply_to_one_root(spark):
    """All of them quote one passage, in their own conversation or in another one; most others quote nothing."""
    n = 6_000
    rows = [(0, 0, "a", "one passage that they all quote")]
    rows += [(0 if k % 2 else k, k, "b", f"> one passage that they all quote\nreply {k}") if k % 3 == 0 else (k % 50 + 7_000, k, "c", f"message {k}") for k in range(1, n)]
    df = Q.link(spark.createDataFrame(rows, SCHEMA).repartition(8))
    found = {(r["conv_id"], r["turn"]): r for r in df.collect()}
    replies = [r for r in found.values() if r["depth"]]
    assert len(replies) == (n - 1) // 3 and all((r["reply_conv"], r["reply_turn"], r["thread_conv"], r["thread_turn"]) == (0, 0, 0, 0) for r in replies)
    assert sorted(r["position"] for r in replies) == list(range(1, len(replies) + 1))


def test_rows_of_a_hot_key_stay_in_their_tasks(spark, tmp_path):
    rows = spark.range(0, 30_000, 1, 4).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    rows.write.parquet(str(tmp_path / "many"))
    spark.range(-1, 20_000).select(F.col("id").alias("k"), (2 * F.col("id")).alias("v")).write.parquet(str(tmp_path / "one"))
    many, one = spark.read.parquet(str(tmp_path / "many")), spark.read.parquet(str(tmp_path / "one"))
    for how in ("inner", "left"):
        found = hot_join(many, one, "k", how=how)
        expected = many.join(one, "k", how)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
        # The hot key's 10,000 rows lie where they were read, in no task more than a quarter.
        hot = found.filter("k = -1").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in hot) <= 2_600 and sum(r["count"] for r in hot) == 10_000


def test_own_columns_keep_their_values(spark):
    own = {"_lines": 1, "_text": 2, "lines": 3, "row": 4, "passages": 5, "thread": 6, "rank": 7, "a.b": 8, "quoted": 9}
    df = spark.createDataFrame([(1, 0, "a", "said\n> before", *own.values())], ["conv_id", "turn", "role", "text", *own])
    out = Q.link(df).first().asDict()
    assert {c: out[c] for c in own} == own and out["body"] == "said" and out["n_quotes"] == 1


def test_a_long_thread_is_placed_and_cut_into_segments(spark):
    rows = [(1, k, "a", "the very first message of all" if k == 0 else f"> the very first message of all\nanswer {k}") for k in range(3_000)]
    linked = Q.link(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted((r["position"], r["turn"]) for r in linked.select("position", "turn").collect()) == [(k, k) for k in range(3_000)]
    assert sorted(r["n_messages"] for r in Q.conversations(linked).collect()) == [1_000, 1_000, 1_000]


def test_originals_come_before_quotes(spark):
    found = link(spark, (1, 0, "a", "> a passage of some length"), (1, 1, "b", "a passage of some length"), (1, 2, "c", "> a passage of some length\nseen"))
    assert found[1, 0, ""]["reply_turn"] is None
    assert found[1, 2, "seen"]["reply_turn"] == 1


def test_a_passage_shared_by_many_costs_a_row_each(spark):
    rows = [(k, 0, "a", "the very same first message of all") for k in range(300)] + [(k, 1, "b", "> the very same first message of all\nok") for k in range(300)]
    found = Q.link(spark.createDataFrame(rows, SCHEMA))
    assert found.count() == 600
    assert found.filter("turn = 1 and reply_conv = conv_id and reply_turn = 0").count() == 300


def test_edges(spark):
    rows = [(None, 1, "x", None, 1), (3, None, "x", "> quote of nothing", 1), (1, 1, "b", "same", 1), (1, 1, "b", "same", 1), (1, 2, "b", "", 1), (1, 3, "b", ">" * 50 + " deep", 1), (1, 4, "b", "word " * 50_000, 1), (1, 5, "b", "> \n>\n", 1), (1, 6, "b", "> q\n>> r\n" * 20_000, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", depth int")
    out = Q.link(df)
    found = out.collect()
    assert len(found) == len(rows) and len(set(out.columns)) == len(out.columns)
    assert {r["max_level"] for r in found if r["turn"] == 3} == {50}
    assert Q.link(df.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["conversations"])
def test_plain_conversations_stay_as_they_are(spark, sf, table):
    messages = spark.read.parquet(f"{sf}/{table}.parquet")
    out = Q.link(messages)
    assert out.count() == messages.count() and out.filter("n_quotes > 0").count() == 0
    assert out.join(messages, ["conv_id", "turn"]).filter("trim(text) != body").count() == 0


def test_same_rows_as_sql(spark, sf, tmp_path):
    rnd = random.Random(4)
    said: list[str] = []
    rows = []
    for conv in range(12):
        for turn in range(8):
            lines = []
            for _ in range(rnd.randint(0, 3)):
                level = rnd.randint(1, 3)
                passage = rnd.choice(said) if said and rnd.random() < 0.8 else "nobody ever said these words"
                lines += ["On some day X wrote:"] * (rnd.random() < 0.3)
                lines += [" >" * level + " " + x for x in passage.split("\n")]
                lines += [rnd.choice(["", "Yes.", f"an answer of its own, number {rnd.randint(0, 30)}"])]
            own = "\n".join(f"Sentence {rnd.randint(0, 40)} of the text; it is long enough" for _ in range(rnd.randint(1, 3)))
            said += [own, own.split("\n")[0].upper()]
            rows.append((conv, turn, rnd.choice(["user", "assistant"]), "\n".join([*lines, own])))
    folder = str(tmp_path)
    spark.createDataFrame([*rows, (None, 1, "x", "> Sentence"), (3, None, "x", None)], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    for where, files in ((folder, f"{folder}/conversations.parquet/*.parquet"), (sf, f"{sf}/conversations.parquet")):
        df = op6_quotation_links(spark, where)
        c = duckdb.connect()
        c.execute(f"create view conversations as select * from read_parquet('{files}')")
        expected = c.execute(OP6_SQL)
        order = [[d[0] for d in expected.description].index(x) for x in df.columns]
        plain = sorted(repr(tuple(r[i] for i in order)) for r in expected.fetchall())
        assert sorted(repr(tuple(r)) for r in df.collect()) == plain
        assert where == sf or sum(r["depth"] > 1 for r in df.collect()) > 5
