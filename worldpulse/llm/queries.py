"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worldpulse.llm import (
    bpe_codec,
    decontamination,
    histogram_sharding,
    language_id,
    lexical_search,
    line_dedup,
    ngram_jaccard,
    periodic_runs,
    quality_crf,
    quality_rules,
    quotation_links,
    token_counts,
    training_order,
)
from worldpulse.llm.shared import materialize, own_dir, small_batches, table

BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_RANKS = "byte_bpe_50k.tiktoken"
TOKEN_LIMIT = 512
SHARDS = 40


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.count_tokens(docs, public_tokenizers.path(BYTE_BPE))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.apply(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.round_trip(docs, public_tokenizers.path(BYTE_BPE)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _fold(parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id, which is then neither learnt from nor held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def quality_field(docs: DataFrame, labels: DataFrame) -> quality_crf.Field:
    return quality_crf.learn(docs.filter(_fold(4) != 2), labels.filter(_fold(4) != 2))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_crf.score(docs, quality_field(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def language_training(docs: DataFrame) -> dict[str, bytes]:
    return language_id.learn(docs.filter(_fold(5) != 0))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs, language_training(docs))
    return found.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation_links.link(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def _quoting(messages: DataFrame) -> DataFrame:
    """``conversations`` as mail: every turn quotes the one before it, every third one just its first line, and adds its own text."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    quoted = F.regexp_replace(F.when(F.col("turn") % 3 == 2, F.substring_index(before, "\n", 1)).otherwise(before), "(^|\n)", "$1> ")
    text = F.when(before.isNull(), F.col("text")).otherwise(F.concat(F.lit("Then X wrote:\n"), quoted, F.lit("\n\n"), F.col("text")))
    return messages.select("conv_id", "turn", "role", text.alias("text"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over messages built to quote each other, assembled into conversations without quotes."""
    linked = quotation_links.link(_quoting(table(spark, sf_dir, "conversations")))
    found = quotation_links.conversations(linked)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["conv_id"].cast("string"), F.lit("/"), t["turn"].cast("string"), F.lit(" "), t["role"], F.lit(": "), t["body"])), "\n")
    return found.select("thread_conv", "thread_turn", F.col("segment").cast("long").alias("segment"), "n_messages", said.alias("said"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(decontamination.mark(docs, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    digest = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group_key"),
        # The last bits differ between rows of one id, so that a large group of equal rows can be split too.
        F.xxhash64("doc_id").bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(0xFFFF))).alias("row_key"),
    )
    placed = histogram_sharding.shard(materialize(digest, "op9"), SHARDS, order=["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written below the shared folder; every sequence with its slot, its place in them, and the file's size and digest."""
    small_batches(spark, "1m")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    special = training_order.special_tokens(public_tokenizers.path(BYTE_BPE))
    codes, total = training_order.numbered(docs, public_tokenizers.path(BYTE_BPE_RANKS), public_tokenizers.PATTERN, special)
    return training_order.write_shards(codes, total, f"{own_dir(spark)}/op10-shards-{uuid.uuid4().hex}")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup(docs, least_chars=40, least_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def _planted(docs: DataFrame) -> DataFrame:
    """Every tenth text, by a checksum of its id, has words that repeat from a place on, so that there are runs to find."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    # The words are bound to a name by a list of one, and only where the text is changed at all.
    text = F.when((h % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.transform(F.array(words), repeated)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, "1m")
    found = periodic_runs.collapse_runs(_planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    run, listed = F.col("run"), F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    # Runs are in the order of start and period, so of equal ratios the first one stays.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    return found.withColumn("run", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        run["start"].alias("start"),
        run["length"].alias("length"),
        run["period"].alias("period"),
        F.floor(1000 * run["length"] / run["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    index = lexical_search.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quality_rules": op2_quality_rules,
        "op3_bpe_codec": op3_bpe_codec,
        "op4_quality_crf": op4_quality_crf,
        "op5_language_id": op5_language_id,
        "op6_quotation_links": op6_quotation_links,
        "quoted_conversations": quoted_conversations,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_decontamination": op8_decontamination,
        "op9_histogram_sharding": op9_histogram_sharding,
        "op10_training_order": op10_training_order,
        "op11_line_dedup": op11_line_dedup,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_lexical_search": op13_lexical_search,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as x
  from w
),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 75 * (na.n + nb.n - k)),
steps as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, t.b from reach r join steps t on t.a = r.other)
select r.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.other) as component_id from reach r left join n on n.doc_id = r.doc_id group by r.doc_id
"""

OP8_SQL = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
i as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
p as (
  select distinct item, least(13, len(w)) as size, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda k: array_to_string(w[k:k + 12], ' '))) as x
  from i where len(w) > 0
),
sizes as (select distinct size from p),
places as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from d, sizes where len(w) >= size),
hits as (select t.doc_id, t.k, t.size, p.item from places t join p on p.size = t.size and p.x = array_to_string(t.w[t.k:t.k + t.size - 1], ' ')),
words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(k, k + size)) as j from (select distinct doc_id, k, size from hits)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""


def _normal(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_LINKED = f"""
m as (select *, coalesce(text, '') as t, row_number() over () as rid from messages),
cut as (select rid, conv_id, turn, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from m where contains(t, '>')),
marked as (select *, regexp_extract(line, '^(?:[ \\t]*>)+') as mark from cut),
lines as (select rid, conv_id, turn, pos, len(regexp_replace(mark, '[^>]', '', 'g')) as level, trim(substr(line, len(mark) + 1)) as content from marked),
near_lines as (select *, lead(level) over w as following, case when lag(level) over w is distinct from level then 1 else 0 end as begins from lines window w as (partition by rid order by pos)),
own as (select rid, string_agg(content, chr(10) order by pos) as own from near_lines where level = 0 and not (regexp_matches(content, '(?i)wrote:[ \\t\\r]*$') and coalesce(following, 0) > 0) group by rid),
bodies as (select m.rid, m.conv_id, m.turn, m.role, regexp_replace(case when contains(t, '>') then coalesce(own.own, '') else t end, '^\\s+|\\s+$', '', 'g') as body from m left join own on own.rid = m.rid),
runs as (select *, sum(begins) over (partition by rid order by pos) as run from near_lines),
passages as (select rid, conv_id, turn, run, min(level) as level, string_agg(content, chr(10) order by pos) as whole from runs where level > 0 group by rid, conv_id, turn, run),
asked as (
  select distinct conv_id, turn, level, x from (
    select conv_id, turn, level, {_normal("whole")} as x from passages
    union all select conv_id, turn, level, {_normal("part")} from (select conv_id, turn, level, unnest(regexp_split_to_array(whole, '\\n\\s*\\n')) as part from passages)
    union all select conv_id, turn, level, {_normal("content")} from runs where level > 0)
  where x <> '' and conv_id is not null and turn is not null),
held as (
  select conv_id, turn, x from (
    select conv_id, turn, {_normal("body")} as x from bodies
    union all select conv_id, turn, {_normal("part")} from (select conv_id, turn, unnest(regexp_split_to_array(body, '\\n\\s*\\n')) as part from bodies)
    union all select conv_id, turn, {_normal("line")} from (select conv_id, turn, unnest(string_split(body, chr(10))) as line from bodies))
  where x <> '' and conv_id is not null and turn is not null),
near as (select conv_id, x, min(turn) as turn from held group by conv_id, x),
far as (select x, min({{'c': conv_id, 't': turn}}) as o from near group by x),
met as (
  select a.conv_id, a.turn, a.level, len(a.x) as size, case when n.turn < a.turn then {{'c': a.conv_id, 't': n.turn}} when f.o.c < a.conv_id then f.o end as o
  from asked a left join near n on n.conv_id = a.conv_id and n.x = a.x left join far f on f.x = a.x),
links as (select conv_id, turn, arg_min(o, {{'l': level, 's': -size, 'c': o.c, 't': o.t}}) as o from met where o is not null group by conv_id, turn),
climb(conv_id, turn, tc, tt, depth) as (
  select conv_id, turn, o.c, o.t, 1 from links
  union all select c.conv_id, c.turn, l.o.c, l.o.t, c.depth + 1 from climb c join links l on l.conv_id = c.tc and l.turn = c.tt),
tops as (select conv_id, turn, arg_max(tc, depth) as tc, arg_max(tt, depth) as tt, max(depth) as depth from climb group by conv_id, turn),
quotes as (select rid, count(*) as n, max(level) as level from passages group by rid),
placed as (
  select b.conv_id, b.turn, b.role, b.body, cast(coalesce(q.n, 0) as int) as n_quotes, cast(coalesce(q.level, 0) as int) as max_level,
    l.o.c as reply_conv, l.o.t as reply_turn, coalesce(t.tc, b.conv_id) as thread_conv, coalesce(t.tt, b.turn) as thread_turn, cast(coalesce(t.depth, 0) as int) as depth
  from bodies b left join quotes q on q.rid = b.rid left join links l on l.conv_id = b.conv_id and l.turn = b.turn left join tops t on t.conv_id = b.conv_id and t.turn = b.turn),
linked as (
  select *, case when conv_id is null or turn is null then 0 else row_number() over (partition by conv_id is null or turn is null, thread_conv, thread_turn order by conv_id, turn, role nulls first, md5(body)) - 1 end as position
  from placed)
"""

OP6_SQL = f"with recursive messages as (select * from conversations), {_LINKED} select conv_id, turn, role, body, n_quotes, max_level, reply_conv, reply_turn, thread_conv, thread_turn, depth, position from linked"

QUOTED_CONVERSATIONS_SQL = f"""
with recursive turns as (select *, lag(text) over (partition by conv_id order by turn) as before from conversations),
messages as (
  select conv_id, turn, role, case when before is null then text else 'Then X wrote:' || chr(10) || regexp_replace(case when turn % 3 = 2 then split_part(before, chr(10), 1) else before end, '(^|\\n)', '\\1> ', 'g') || chr(10) || chr(10) || text end as text
  from turns),
{_LINKED}
select thread_conv, thread_turn, position // 1000 as segment, count(*) as n_messages,
  string_agg(cast(conv_id as varchar) || '/' || cast(turn as varchar) || ' ' || role || ': ' || body, chr(10) order by position) as said
from linked where conv_id is not null and turn is not null group by all
"""


OP11_SQL = """
with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select r, doc_id, generate_subscripts(l, 1) as pos, unnest(l) as line from docs),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
held as (select k, max(doc_id) as holder from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
marked as (select keyed.*, held.k is not null and keyed.doc_id <> held.holder as gone from keyed left join held on held.k = keyed.k)
select min(doc_id) as doc_id, count(*) as n_lines, count_if(gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from marked group by r
"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13_SQL = f"""
with sized as (select * from (select row_number() over () as r, doc_id, {_TERMS} as w from documents) where len(w) > 0),
totals as (select count(*) as docs, cast(sum(len(w)) as bigint) as terms from sized),
tfs as (select r, t, count(*) as tf from (select r, unnest(w) as t from sized) group by r, t),
dfs as (select t, count(*) as df from tfs group by t),
asked as (select distinct q, item_id, unnest(w) as t from (select row_number() over () as q, item_id, {_TERMS} as w from benchmark)),
scored as (
  select q, item_id, s.doc_id, s.r, sum(cast(floor(1000 * ln((2 * docs + 2) / cast(2 * df + 1 as double))) as bigint) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(s.w) * docs) // terms)))) as score
  from asked join tfs using (t) join dfs using (t) join sized s using (r), totals group by q, item_id, s.doc_id, s.r)
select item_id, cast(place as int) as rank, doc_id, cast(score as bigint) as score
from (select *, row_number() over (partition by q order by score desc, doc_id) as place from scored where score > 0) where place <= 50
"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, trained models, sketches and hashed orders can't be said in SQL; tests hold those against brute force."""
    return {"op6_quotation_links": OP6_SQL, "quoted_conversations": QUOTED_CONVERSATIONS_SQL, "op7_ngram_jaccard": OP7_SQL, "op8_decontamination": OP8_SQL, "op11_line_dedup": OP11_SQL, "op13_lexical_search": OP13_SQL}
