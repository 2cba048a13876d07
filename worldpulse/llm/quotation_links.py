"""Operator 6, quotation linking, in DataFrame functions only.

A line's quote level is the number of ``>`` it begins with. Consecutive lines of one level above 0 are
a quoted passage; what is left, without lines that introduce a quotation ("... wrote:"), is the
message's body. Passages and bodies are normalised (lower case, only letters and digits, single spaces)
and hashed, both as a whole, by paragraph and by line, so a re-wrapped paragraph is found as well as a single
line. A passage's original is the first message that has it in its body: in the same conversation, else in an earlier
one; it's always before the message that quotes it. (With ``least_far`` over 0, passages of fewer normalised characters
are looked for in their own conversation alone, as short ones are said everywhere; 0 loses no link.) A message replies to the original of its lowest-level
passage, the longest of these, then the first. Replies are followed
to the thread's first message by doubling steps. Threads are ordered by conversation and turn, so
a message stands after what it replies to: ``position`` is its place in the thread, and :func:`conversations`
assembles a thread's bodies in that order.

Originals are reduced to one row per conversation and hash, and per hash, before they are joined, so a
passage that a third of all messages share costs a row per message, not pairs of messages; the rows of such a passage, and
those of the replies to one root, stay where they are, as their one original is broadcast (:func:`hot_join`). Places come from sorted
ranges and their sizes, and conversations are assembled in segments, so no thread is collected in one task.

Null texts have an empty body and no quotes. Messages without conversation or turn link to nothing and
are threads of their own, at position 0. Rows with equal conversation and turn share one link, and stand beside each
other in the thread, ordered by role and a digest of the body. Very long texts are parsed whole, inside one row. Extra
columns pass through under any name; one named like an output is replaced by it. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldpulse.llm.shared import hot_join, materialize, named, others, own_dir, pack, small_table, store, unpack

MARK = r"^(?:[ \t]*>)+"
INTRODUCTION = r"(?i)wrote:[ \t\r]*$"
#: Messages of one row of an assembled conversation.
SEGMENT = 1_000
KEY = ["conv_id", "turn"]
PARAGRAPH = r"\n\s*\n"
OUTPUTS = ("body", "n_quotes", "max_level", "reply_conv", "reply_turn", "thread_conv", "thread_turn", "depth", "position")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """``array<struct<level, content>>``."""

    def one(line: Column) -> Column:
        mark = F.regexp_extract(line, MARK, 0)
        return F.struct(
            F.char_length(F.regexp_replace(mark, "[^>]", "")).alias("level"),
            F.trim(F.substring(line, F.char_length(mark) + 1, F.char_length(line))).alias("content"),
        )

    return F.transform(F.split(text, "\n"), one)


def _starts(lines: Column) -> Column:
    """Where a run of lines of one level begins."""

    def begins(i: Column) -> Column:
        return (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"])

    return F.filter(F.transform(lines, lambda x, i: i), begins)


def _passages(lines: Column, starts: Column) -> Column:
    """The runs above level 0, as ``array<struct<level, lines>>``; each line is copied once."""

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(lines))
        return F.struct(F.get(lines, start)["level"].alias("level"), F.transform(F.slice(lines, start + 1, end - start), lambda x: x["content"]).alias("lines"))

    return F.filter(F.transform(starts, run), lambda r: r["level"] > 0)


def split_quotes(rows: DataFrame) -> DataFrame:
    """The column ``text`` of ``rows`` as ``body`` and ``passages``; the other columns have none of the names used here."""
    keep = [c for c in rows.columns if c != "text"]
    quoted, lines = F.col("quoted"), F.col("lines")
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["content"].rlike(INTRODUCTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    text = F.coalesce("text", F.lit(""))
    parsed = rows.select(*keep, text.alias("text"), text.contains(">").alias("quoted")).withColumn("lines", F.when(quoted, _lines(F.col("text")))).withColumn("starts", F.when(quoted, _starts(lines)))
    none = F.array().cast("array<struct<level:int,lines:array<string>>>")
    body = F.regexp_replace(F.when(quoted, F.array_join(F.transform(own, lambda x: x["content"]), "\n")).otherwise(F.col("text")), r"^\s+|\s+$", "")
    return parsed.select(*keep, body.alias("body"), F.when(quoted, _passages(lines, F.col("starts"))).otherwise(none).alias("passages"))


def _keys(*texts: Column) -> Column:
    """Distinct hashes of arrays of texts, normalised, with their lengths."""
    kept = F.transform(F.concat(*texts), normalised)
    return F.transform(F.array_distinct(F.filter(kept, lambda x: x != "")), lambda x: F.struct(F.sha2(x, 256).alias("hash"), F.char_length(x).alias("size")))


def replies(parsed: DataFrame, least_far: int = 0) -> DataFrame:
    """``(conv_id, turn, reply_conv, reply_turn)`` of each message that quotes an earlier one. ``parsed`` is a stored table."""
    known = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoting = known.filter(F.size("passages") > 0).select(*KEY, F.explode("passages").alias("p"))
    whole = F.array_join("p.lines", "\n")
    asked = quoting.select(*KEY, F.col("p.level").alias("level"), F.explode(_keys(F.array(whole), F.split(whole, PARAGRAPH), F.col("p.lines"))).alias("k")).select(*KEY, "level", "k.hash", "k.size").distinct()
    asked = materialize(asked, "op6-asked")
    # Stored, so that both sides of the next join are plain exchanges, of which adaptive execution splits a hot passage's.
    wanted = materialize(asked.select("hash").distinct(), "op6-wanted")
    held = known.select(*KEY, F.explode(_keys(F.array("body"), F.split("body", PARAGRAPH), F.split("body", "\n"))).alias("k")).select(*KEY, "k.hash")
    held = held.join(wanted, "hash", "left_semi")
    near = materialize(held.groupBy("conv_id", "hash").agg(F.min("turn").alias("near_turn")), "op6-originals")
    far = near.groupBy("hash").agg(F.min(F.struct(F.col("conv_id").alias("conv_id"), F.col("near_turn").alias("turn"))).alias("far"))
    # A conversation may hold a third of all messages, and they may quote one passage.
    met = hot_join(asked, near, ["conv_id", "hash"], how="left")
    here = F.when(F.col("near_turn") < F.col("turn"), F.struct("conv_id", F.col("near_turn").alias("turn")))
    met = materialize(met.select(*KEY, "level", "hash", "size", here.alias("here")), "op6-met")
    there = hot_join(met.filter(F.col("here").isNull() & (F.col("size") >= least_far)), materialize(far, "op6-far"), "hash").filter(F.col("far.conv_id") < F.col("conv_id"))
    found = [met.filter("here is not null").select(*KEY, "level", "size", F.col("here").alias("original")), there.select(*KEY, "level", "size", F.col("far").alias("original"))]
    linked = found[0].unionByName(found[1])
    best = F.min_by("original", F.struct(F.col("level"), -F.col("size"), F.col("original.conv_id"), F.col("original.turn")))
    return linked.groupBy(*KEY).agg(best.alias("o")).select(*KEY, F.col("o.conv_id").alias("reply_conv"), F.col("o.turn").alias("reply_turn"))


def threads(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, thread_conv, thread_turn, depth)`` for the stored ``links``: each step doubles how far a message sees."""
    seen = links.select(*KEY, F.col("reply_conv").alias("thread_conv"), F.col("reply_turn").alias("thread_turn"), F.lit(1).alias("depth"))
    while True:
        further = seen.select(F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"), F.col("thread_conv").alias("next_conv"), F.col("thread_turn").alias("next_turn"), F.col("depth").alias("more"))
        # All replies of a root meet in one key.
        step = hot_join(seen, further, ["thread_conv", "thread_turn"], how="left")
        step = materialize(step, "op6-threads")
        seen = step.select(*KEY, F.coalesce("next_conv", "thread_conv").alias("thread_conv"), F.coalesce("next_turn", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if step.filter("more is not null").limit(1).count() == 0:
            return seen


def _ranked(linked: DataFrame) -> DataFrame:
    """``linked`` stored in thread order, with ``rank``, the place of each row in all: its range's start and its place there."""
    spark = linked.sparkSession
    path = f"{own_dir(spark)}/op6-ranges-{uuid.uuid4().hex}"
    order = ["thread_conv", "thread_turn", "conv_id", "turn", "role", "digest"]
    keyed = linked.withColumn("digest", F.md5("body"))
    # Rows that are equal in all of that are spread over ranges, in any order.
    spread = keyed.withColumn("place", F.monotonically_increasing_id())
    store(spread.repartitionByRange(*order, "place").sortWithinPartitions(*order, "place").drop("place", "digest"), path)
    stored = spark.read.schema(linked.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_in_file"))
    # A file per range, whose name begins with the range's number.
    sizes = sorted(((int(r["file"].split("-")[1]), r["file"], r["n"]) for r in stored.groupBy("file").agg(F.count("*").alias("n")).collect()))
    starts, total = [], 0
    for _, file, n in sizes:
        starts.append((file, total))
        total += n
    return stored.join(F.broadcast(small_table(spark, starts, "file string, start long")), "file").withColumn("rank", F.col("start") + F.col("row_in_file")).drop("file", "row_in_file", "start")


def link(messages: DataFrame, text_col: str = "text", role_col: str = "role", least_far: int = 0) -> DataFrame:
    """``messages`` without the text, with ``body``, ``n_quotes``, ``max_level``, ``reply_conv``, ``reply_turn``,
    ``thread_conv``, ``thread_turn``, ``depth`` and ``position``."""
    keep = others(messages, text_col, *OUTPUTS)
    rows = pack(messages, keep, conv_id=F.col("conv_id"), turn=F.col("turn"), role=named(role_col), text=named(text_col))
    parsed = materialize(split_quotes(rows), "op6-parsed")
    links = materialize(replies(parsed, least_far), "op6-links")
    linked = parsed.join(links, KEY, "left").join(threads(links), KEY, "left").select(
        "row",
        *KEY,
        "role",
        "body",
        F.size("passages").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).alias("max_level"),
        "reply_conv",
        "reply_turn",
        F.coalesce("thread_conv", "conv_id").alias("thread_conv"),
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    thread = F.struct("thread_conv", "thread_turn")
    ranked = materialize(_ranked(materialize(linked, "op6-linked")).withColumn("thread", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), thread)), "op6-ranked")
    known = ranked.filter("thread is not null")
    first = materialize(known.groupBy("thread").agg(F.min("rank").alias("first")), "op6-firsts")
    placed = hot_join(known, first, "thread").withColumn("position", F.col("rank") - F.col("first"))
    placed = placed.select(*ranked.columns, "position").unionByName(ranked.filter("thread is null").withColumn("position", F.lit(0).cast("long")))
    return placed.select(*unpack(keep), *OUTPUTS)


def conversations(linked: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The threads of :func:`link` in reply order, without quotes: a row per ``segment`` messages of a thread with
    ``turns``, an array of ``(position, conv_id, turn, role, body)``. Messages without conversation or turn belong to none."""
    turn = F.struct("position", "conv_id", "turn", "role", "body")
    known = linked.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).withColumn("segment", F.floor(F.col("position") / segment))
    return known.groupBy("thread_conv", "thread_turn", "segment").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(turn)).alias("turns"))
