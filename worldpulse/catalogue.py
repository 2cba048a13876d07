"""The registered queries of the read model, and the same questions in DuckDB's SQL on the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldpulse import schemas
from worldpulse.api import Questions, answers
from worldpulse.catalog import load, view, with_views
from worldpulse.functions import columns as C
from worldpulse.operators import cascade, identity, ledger, snapshots, stats
from worldpulse.plans import ids, ingest
from worldpulse.plans.store import scratch, staged
from worldpulse.plans.tables import Changes, Tables, merged, run
from worldpulse.sources import jdbc
from worldpulse.sources import pages as P
from worldpulse.sources import tables as S
from worldpulse.streaming import names

Query = Callable[[SparkSession, str], DataFrame]
CUTOFF = "2000-06-01 00:00:00"
AS_OF = "2000-12-01 00:00:00"
WORLD, FROM, TO = "NATION_3", "2024-01-05 00:00:00", "2024-01-06 00:00:00"
STAT_NAMES = ("Customer#000000001", "Customer#000000002", "Customer#000000004")
CATEGORY = "1-URGENT"
BASE = "https://game.example/community/"
#: Keys that a page of each of the five segments' lists is for, so that it has about 50 rows, as the site's pages do.
KEYS_PER_PAGE = 250

_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracle[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


def _ntz(x: str):
    return F.lit(x).cast("timestamp_ntz")


LATEST = "select world_id, arg_max(players_online, {'a': scrape_time, 'b': id}) as players_online, max(scrape_time) as scrape_time from scrapes group by world_id"

# --- A1 to A4: the population ---------------------------------------------------------------


@query(with_views(f"select cast(coalesce(sum(players_online), 0) as int) as total from ({LATEST}) l join worlds w on w.id = l.world_id", "worlds", "scrapes"))
def online_total(spark: SparkSession, sf: str) -> DataFrame:
    """A1"""
    return snapshots.online_total(view(spark, sf, "worlds"), view(spark, sf, "scrapes"))


@query(with_views(f"select w.name as world, coalesce(l.players_online, 0) as players_online from worlds w left join ({LATEST}) l on l.world_id = w.id", "worlds", "scrapes"))
def worlds_online(spark: SparkSession, sf: str) -> DataFrame:
    """A2"""
    return snapshots.worlds_online(view(spark, sf, "worlds"), view(spark, sf, "scrapes"))


@query(with_views(f"select w.name as world, coalesce(l.players_online, 0) as players_online from worlds w left join ({LATEST}) l on l.world_id = w.id where w.name in ('NATION_3', 'NATION_21')", "worlds", "scrapes"))
def world_now(spark: SparkSession, sf: str) -> DataFrame:
    """A3, for a world with and one without snapshots"""
    return snapshots.world_now(view(spark, sf, "worlds"), view(spark, sf, "scrapes"), "NATION_3", "NATION_21")


@query(with_views(f"select scrape_time, players_online from scrapes s join worlds w on w.id = s.world_id where w.name = '{WORLD}' and scrape_time between timestamp '{FROM}' and timestamp '{TO}' order by scrape_time, s.id", "worlds", "scrapes"))
def world_history(spark: SparkSession, sf: str) -> DataFrame:
    """A4, FLT2, SORT1"""
    return snapshots.world_history(view(spark, sf, "worlds"), view(spark, sf, "scrapes"), WORLD, _ntz(FROM), _ntz(TO))


@query(with_views("select user_id as world_id, arg_max(ts, {'a': ts, 'b': event_id}) as scrape_time, cast(floor(arg_max(value, {'a': ts, 'b': event_id})) as int) as players_online from events group by user_id", "scrapes"))
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """TOP1, AGG2 by a partial maximum, over users"""
    rows = load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("world_id"), F.col("ts").alias("scrape_time"), F.floor("value").cast("int").alias("players_online"))
    return snapshots.latest(rows)


@query("select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def latest_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    """TOP1, SORT2 by a limited window"""
    return snapshots.latest_by_rank(load(spark, sf, "events"), "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "ts", "event_type")


@query(with_views("select w.id, w.name from worlds w where not exists (select 1 from scrapes s where s.world_id = w.id)", "worlds", "scrapes"))
def worlds_without_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN7, FLT18"""
    return snapshots.worlds_without_snapshot(view(spark, sf, "worlds"), view(spark, sf, "scrapes"))


@query(with_views("select id, name, location from worlds where name = 'NATION_3'", "worlds"))
def world_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """FLT1"""
    return view(spark, sf, "worlds").filter(F.col("name") == WORLD)


@query(with_views("select id, name, location from worlds order by id", "worlds"))
def all_worlds(spark: SparkSession, sf: str) -> DataFrame:
    """SRC6, SNK14"""
    return view(spark, sf, "worlds").orderBy("id")


@query(with_views("select world_id, arg_min(players_online, {'a': scrape_time, 'b': id}) as players_online from scrapes where players_online > 20 group by world_id", "scrapes"))
def first_non_null(spark: SparkSession, sf: str) -> DataFrame:
    """AGG3: values up to 20 stand for unknown ones"""
    known = view(spark, sf, "scrapes").withColumn("players_online", F.when(F.col("players_online") > 20, F.col("players_online")))
    return snapshots.first_known(known, "world_id", "players_online", "scrape_time", "id")


@query(with_views("select cast(date_trunc('day', scrape_time) as date) as day, world_id, count(*) as n from scrapes group by all", "scrapes"))
def daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """An addition: tumbling days"""
    return snapshots.daily_counts(view(spark, sf, "scrapes"))


# --- A5 and A6: characters ------------------------------------------------------------------

RECENT = f"(active = true or (active = false and inactive_date > timestamp '{CUTOFF}'))"


@query(with_views(f"select c.id, n.name as requested_name, c.vocation from character_names n join characters c on c.id = n.character_id where {RECENT}", "characters", "character_names"))
def character_by_any_name(spark: SparkSession, sf: str) -> DataFrame:
    """A5, FLT4, JOIN1, for every name"""
    return identity.by_any_name(view(spark, sf, "character_names"), view(spark, sf, "characters"), _ntz(CUTOFF)).select("id", "requested_name", "vocation")


@query(with_views(f"select n.name as requested_name, s.date, s.value, s.rank, w.name as world from character_names n join stats s on s.character_id = n.character_id join worlds w on w.id = s.world_id where {RECENT} and n.name in {STAT_NAMES} and s.category = '{CATEGORY}' order by 1, 2, s.id", "worlds", "character_names", "stats"))
def stat_history(spark: SparkSession, sf: str) -> DataFrame:
    """A6, FLT8, JOIN2, SORT3"""
    found = identity.by_any_name(view(spark, sf, "character_names"), view(spark, sf, "characters"), _ntz(CUTOFF), *STAT_NAMES)
    return stats.stat_history(found, view(spark, sf, "stats"), view(spark, sf, "worlds"), CATEGORY)


@query(with_views(f"select n.name as requested_name, s.category, count(*) as n, max(s.value) as best from character_names n join stats s on s.character_id = n.character_id where {RECENT} group by all", "character_names", "stats"))
def best_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """A6 over all names and categories, reduced"""
    names = view(spark, sf, "character_names").filter(identity.recent(_ntz(CUTOFF)))
    joined = view(spark, sf, "stats").join(names.select("character_id", F.col("name").alias("requested_name")), "character_id")
    return joined.groupBy("requested_name", "category").agg(F.count("*").alias("n"), F.max("value").alias("best"))


@query(with_views("select id, character_id, name, active, inactive_date from character_names where name = 'Customer#000000004' and active = true", "character_names"))
def active_name(spark: SparkSession, sf: str) -> DataFrame:
    """FLT5"""
    return identity.active_by_name(view(spark, sf, "character_names"), "Customer#000000004")


@query(with_views("select id, character_id, name, active, inactive_date from character_names where character_id = 5 and active = true", "character_names"))
def active_name_of_character(spark: SparkSession, sf: str) -> DataFrame:
    """FLT6"""
    return identity.active_by_character(view(spark, sf, "character_names"), 5)


@query(with_views("select id, character_id, name, active, inactive_date from character_names where name = 'Customer#000000003'", "character_names"))
def name_in_any_state(spark: SparkSession, sf: str) -> DataFrame:
    """FLT7"""
    return identity.by_name(view(spark, sf, "character_names"), "Customer#000000003")


@query(with_views("select id, vocation, world_id from characters where id = 7", "characters"))
def character_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """FLT9"""
    return view(spark, sf, "characters").filter("id = 7")


@query(with_views("select c.id, c.vocation, v.promoted from characters c left join (select * from (values ('BUILDING', 'master builder'), ('MACHINERY', 'chief engineer')) t(name, promoted)) v on v.name = c.vocation", "characters"))
def character_vocation(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN5: characters without a known vocation stay"""
    v = spark.createDataFrame([("BUILDING", "master builder"), ("MACHINERY", "chief engineer")], "vocation string, promoted string")
    return view(spark, sf, "characters").join(F.broadcast(v), "vocation", "left").select("id", "vocation", "promoted")


@query(
    "with c as (select *, lag(event_type) over w as before, row_number() over w as k from events window w as (partition by user_id order by ts, event_id)), "
    "d as (select user_id, event_type, ts, event_id from c where k = 1 or event_type is distinct from before) "
    "select user_id, event_type, ts as valid_from, lead(ts) over (partition by user_id order by ts, event_id) as valid_to, lead(ts) over (partition by user_id order by ts, event_id) is null as active from d"
)
def scd2_names(spark: SparkSession, sf: str) -> DataFrame:
    """OP-SCD2: the event type stands for a user's name"""
    return identity.history(load(spark, sf, "events"), "user_id", "event_type", "ts", "event_id")


@query(_oracle["scd2_names"])
def scd2_stream(spark: SparkSession, sf: str) -> DataFrame:
    """OP-SCD2, OP-ACTIVE: the same history from a stream, in two runs; a late row of another key lets the watermark pass the others"""
    folder, rows = scratch(spark, "names"), load(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    ends = F.make_interval(years=F.lit(1))
    flush = rows.agg(F.lit(-1).cast(rows.schema["user_id"].dataType).alias("user_id"), F.lit("end").alias("event_type"), (F.max("ts") + ends).alias("ts"), F.lit(-1).cast(rows.schema["event_id"].dataType).alias("event_id"))
    parts = (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), flush)
    for number in (0, 1):
        for part in parts[number : 2 * number + 1]:
            part.select("user_id", "event_type", "ts", "event_id").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        found = names.changes(stream, "user_id", "event_type", "ts", "event_id", late_by="365 days")
        names.run_to(found, f"{folder}/out", f"{folder}/checkpoint")
    done = names.history(spark.read.parquet(f"{folder}/out")).filter("key >= 0")
    return done.select(F.col("key").alias("user_id"), F.col("name").alias("event_type"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("valid_from", "valid_to")], "active")


_SEEN = "select c_name as name, case when c_custkey % 10 = 0 then 'Customer#' || lpad(cast(c_custkey + 1 as varchar), 9, '0') else c_name end as former_names, timestamp '2001-01-01 00:00:00' as seen_at from customer union all select 'New#' || cast(n_nationkey as varchar), 'Nobody', timestamp '2001-01-01 00:00:00' from nation"


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    former = F.when(key % 10 == 0, F.concat(F.lit("Customer#"), F.lpad((key + 1).cast("string"), 9, "0"))).otherwise(F.col("c_name"))
    own = load(spark, sf, "customer").select(F.col("c_name").alias("name"), former.alias("former_names"), _ntz("2001-01-01 00:00:00").alias("seen_at"))
    new = load(spark, sf, "nation").select(F.concat(F.lit("New#"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("Nobody").alias("former_names"), _ntz("2001-01-01 00:00:00").alias("seen_at"))
    return identity.resolve(own.unionByName(new), view(spark, sf, "character_names"), _ntz(CUTOFF))


_RESOLVED = f"seen as ({_SEEN}), r as (select s.name, coalesce(o.character_id, f.character_id) as character_id from seen s left join character_names o on o.name = s.name and {RECENT.replace('active', 'o.active').replace('ino.active_date', 'o.inactive_date')} left join character_names f on f.name = s.former_names and f.name <> s.name)"


@query(with_views("select * from (with " + _RESOLVED + " select name, coalesce(character_id, 0) as character_id, character_id is null as is_new from r)", "character_names"))
def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    """OP-RESOLVE, JOIN6, FN-SPLIT, D1: new characters have no id yet and are shown as 0"""
    return _resolved(spark, sf).select("name", F.coalesce("character_id", F.lit(0)).cast("bigint").alias("character_id"), "is_new")


@query(
    with_views(
        "select * from (with " + _RESOLVED + ", now as (select character_id, max(name) as now_name from r where character_id is not null group by 1) "
        "select n.name, coalesce(n.active and not (w.now_name is not null and w.now_name <> n.name), n.active) as active, case when n.active and w.now_name <> n.name then timestamp '2001-01-01 00:00:00' else n.inactive_date end as inactive_date from character_names n left join now w on w.character_id = n.character_id "
        "union all select w.now_name, true, null from now w where not exists (select 1 from character_names n where n.character_id = w.character_id and n.name = w.now_name and n.active) "
        "union all select name, true, null from r where character_id is null)",
        "character_names",
    )
)
def renamed(spark: SparkSession, sf: str) -> DataFrame:
    """OP-ACTIVE, SNK4, SNK5, D2, D3: the name history after all of these were seen"""
    names, folder = view(spark, sf, "character_names"), scratch(spark, "renamed")
    resolved = staged(_resolved(spark, sf), folder, "resolved")
    fresh, _ = ids.allocate(resolved.filter("is_new"), "character_id", ingest.last_character(names), folder)
    return identity.apply_names(names, resolved.filter("not is_new").unionByName(fresh)).select("name", "active", "inactive_date")


@query("select n_name as world, category, cast(vocation_id as int) as vocation_id, cast(page as int) as page from nation, (values " + ", ".join(f"('{c}')" for c in C.CATEGORIES) + ") c(category), range(1, 7) v(vocation_id), range(1, 21) p(page)")
def highscore_grid(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN9, LIM1: 15 categories, 6 vocations and 20 pages of each world"""
    return stats.highscore_grid(view(spark, sf, "worlds"))


@query(
    "with rows_ as (select 'w' || cast(o_custkey % 50 as varchar) as world, o_orderpriority as category, cast(o_custkey % 6 + 1 as int) as vocation_id, cast(o_orderkey % 25 + 1 as int) as page, o_orderkey as value from orders), "
    "got as (select distinct world, category, vocation_id, page from rows_), "
    "gap as (select l.world, l.category, l.vocation_id, min(p.page) as stop from (select distinct world, category, vocation_id from got) l, range(1, 22) p(page) where p.page = 21 or not exists (select 1 from got g where g.world = l.world and g.category = l.category and g.vocation_id = l.vocation_id and g.page = p.page) group by all) "
    "select r.world, r.category, r.vocation_id, r.page, r.value from rows_ r join gap using (world, category, vocation_id) where r.page < gap.stop"
)
def read_until_empty(spark: SparkSession, sf: str) -> DataFrame:
    """LIM1: pages count up to the first empty one, 20 at most"""
    k = F.col("o_custkey")
    rows = load(spark, sf, "orders").select(F.concat(F.lit("w"), (k % 50).cast("string")).alias("world"), F.col("o_orderpriority").alias("category"), (k % 6 + 1).cast("int").alias("vocation_id"), (F.col("o_orderkey") % 25 + 1).cast("int").alias("page"), F.col("o_orderkey").alias("value"))
    return stats.read_pages(rows).select("world", "category", "vocation_id", "page", "value")


# --- Ledger ---------------------------------------------------------------------------------

_TOKENS = "select o_orderkey as id, o_custkey as user_id, 't' || cast(o_orderkey as varchar) as token, o_orderdate as expires_at, o_orderdate as created_at, o_orderkey % 3 = 0 as revoked from orders"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select(k.alias("id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("t"), k.cast("string")).alias("token"), F.col("o_orderdate").alias("expires_at"), F.col("o_orderdate").alias("created_at"), (k % 3 == 0).alias("revoked"))


@query(f"select id, token from ({_TOKENS}) where not revoked and expires_at >= timestamp '{CUTOFF}'")
def token_valid(spark: SparkSession, sf: str) -> DataFrame:
    """FLT20"""
    return ledger.usable(_tokens(spark, sf), _ntz(CUTOFF)).select("id", "token")


@query(f"select id, token, revoked from ({_TOKENS}) where token = 't3'")
def token_by_value(spark: SparkSession, sf: str) -> DataFrame:
    """FLT11"""
    return ledger.by_token(_tokens(spark, sf), "t3").select("id", "token", "revoked")


@query(f"select id, token from ({_TOKENS}) where user_id = 4 and not revoked")
def tokens_of_user(spark: SparkSession, sf: str) -> DataFrame:
    """FLT12"""
    return ledger.unrevoked_of(_tokens(spark, sf), 4).select("id", "token")


@query(f"select id from ({_TOKENS}) where expires_at >= timestamp '{CUTOFF}'")
def tokens_purged(spark: SparkSession, sf: str) -> DataFrame:
    """SNK10"""
    return ledger.purge(_tokens(spark, sf), _ntz(CUTOFF)).select("id")


@query(f"select t.id, u.c_name as username from ({_TOKENS}) t join customer u on u.c_custkey = t.user_id")
def token_users(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN10"""
    users = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    return _tokens(spark, sf).join(users, "user_id").select("id", "username")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def blacklist_anti(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN8: labelled documents stand for blacklisted ids"""
    jti = F.col("doc_id").alias("jti")
    return ledger.allowed(load(spark, sf, "documents").select(jti, "lang"), load(spark, sf, "labels").select(jti)).select(F.col("jti").alias("doc_id"), "lang")


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def blacklist_semi(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN8, FLT10"""
    jti = F.col("doc_id").alias("jti")
    return ledger.blacklisted(load(spark, sf, "documents").select(jti, "lang"), load(spark, sf, "labels").select(jti)).select(F.col("jti").alias("doc_id"), "lang")


@query("select distinct 'u' || cast(user_id as varchar) as jti from events where user_id not in (select s_suppkey from supplier)")
def blacklist_append(spark: SparkSession, sf: str) -> DataFrame:
    """SNK9, OP-LOGOUT: repeated ids give one row, known ones none"""
    asked = load(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("jti"), F.lit("Bearer x").alias("authorization"))
    known = load(spark, sf, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("jti"))
    return ledger.logout(asked, known, _ntz(AS_OF)).select("jti")


@query("select c_name as username, case when c_custkey % 4 = 0 then 'USER' else 'A, B' end as roles from customer where not exists (select 1 from supplier where s_suppkey = c_custkey)")
def register_users(spark: SparkSession, sf: str) -> DataFrame:
    """SNK7, OP-REGISTER, FN-DEFROLE"""
    k = F.col("c_custkey")
    asked = load(spark, sf, "customer").select(F.col("c_name").alias("username"), F.lit("x").alias("password"), F.when(k % 4 == 0, F.lit("  ")).otherwise(F.lit("A, B")).alias("roles"))
    known = load(spark, sf, "supplier").select(F.format_string("Customer#%09d", "s_suppkey").alias("username"))
    return ledger.register(known, asked.unionByName(asked), _ntz(AS_OF)).select("username", "roles")


@query(
    f"select t.token, case when t.id % 7 = 0 then 'invalid refresh token' when u.c_custkey is null then 'unknown user' when t.revoked then 'revoked' when t.expires_at < timestamp '{CUTOFF}' then 'expired' end as refused from ({_TOKENS}) t left join customer u on u.c_custkey = t.user_id and u.c_mktsegment <> 'BUILDING'"
)
def refresh_refused(spark: SparkSession, sf: str) -> DataFrame:
    """OP-REFRESH: why a token isn't exchanged"""
    tokens = _tokens(spark, sf)
    asked = tokens.select("token", F.when(F.col("id") % 7 == 0, "access").otherwise("refresh").alias("type"), F.col("user_id").cast("string").alias("username"))
    users = load(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").cast("string").alias("username"))
    return ledger.refusals(asked, tokens, users, _ntz(CUTOFF)).select("token", "refused")


@query(
    f"with ok as (select id, user_id from ({_TOKENS}) t where not revoked and expires_at >= timestamp '{CUTOFF}') "
    f"select token, user_id, revoked or id in (select id from ok) as revoked from ({_TOKENS}) union all select 'n' || cast(id as varchar), user_id, false from ok"
)
def refresh_rotated(spark: SparkSession, sf: str) -> DataFrame:
    """OP-REFRESH, SNK8: accepted tokens are revoked and get a successor"""
    tokens = _tokens(spark, sf)
    asked = tokens.select("token", F.lit("refresh").alias("type"), F.col("user_id").cast("string").alias("username"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("new_token"))
    users = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("username"))
    return ledger.rotate(asked, tokens, users, _ntz(CUTOFF)).select("token", "user_id", "revoked")


@query("select event_id, user_id from events e where not exists (select 1 from customer c where c.c_mktsegment = 'BUILDING' and c.c_custkey = e.user_id)")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """SNK11"""
    gone = load(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return ledger.without_parents(load(spark, sf, "events").select("event_id", "user_id"), gone, "user_id")


_CASCADE = {
    "worlds": "select cast(n_nationkey as bigint) as id from nation",
    "scrapes": "select cast(event_id as bigint) as id, cast(user_id % 25 as bigint) as world_id from events",
    "scrape_players": "select cast(l_orderkey * 10 + l_linenumber as bigint) as id, cast(l_orderkey as bigint) as scrape_id, cast(l_suppkey as bigint) as character_id from lineitem",
    "character_statrecords": "select cast(o_orderkey as bigint) as id, cast(o_custkey as bigint) as character_id, cast(o_custkey % 25 as bigint) as world_id from orders",
    "guilds": "select cast(s_suppkey as bigint) as id, cast(s_nationkey as bigint) as world_id from supplier",
    "guild_characters": "select cast(l_orderkey * 10 + l_linenumber as bigint) as id, cast(l_suppkey as bigint) as guild_id, cast(l_orderkey as bigint) as character_id from lineitem",
    "users": "select cast(c_custkey as bigint) as id, c_mktsegment as roles from customer",
    "refresh_tokens": "select cast(o_orderkey as bigint) as id, cast(o_custkey as bigint) as user_id from orders",
}


@query(
    "with " + ", ".join(f"{name} as ({sql})" for name, sql in _CASCADE.items()) + ", w as (select id from worlds where id % 5 = 0), u as (select id from users where roles = 'BUILDING'), s as (select id from scrapes where world_id in (select id from w)), g as (select id from guilds where world_id in (select id from w)), "
    "left_ as (select 'worlds' as name, id from worlds where id not in (select id from w) union all select 'scrapes', id from scrapes where id not in (select id from s) union all select 'scrape_players', id from scrape_players where scrape_id not in (select id from s) "
    "union all select 'character_statrecords', id from character_statrecords where world_id not in (select id from w) union all select 'guilds', id from guilds where id not in (select id from g) union all select 'guild_characters', id from guild_characters where guild_id not in (select id from g) "
    "union all select 'users', id from users where id not in (select id from u) union all select 'refresh_tokens', id from refresh_tokens where user_id not in (select id from u)) "
    "select name, count(*) as n, cast(sum(id) as bigint) as ids from left_ group by name"
)
def cascade_of_worlds_and_users(spark: SparkSession, sf: str) -> DataFrame:
    """SNK11: worlds and users are deleted, and over all levels what refers to them"""
    stored = {t: load(spark, sf, t) for t in ("nation", "events", "lineitem", "orders", "supplier", "customer")}
    tables = {name: spark.sql(re.sub(r"from (\w+)$", r"from {\1}", sql), **stored) for name, sql in _CASCADE.items()}
    left = cascade.delete(tables, {"worlds": tables["worlds"].filter("id % 5 = 0"), "users": tables["users"].filter("roles = 'BUILDING'")})
    counted = [rows.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(name).alias("name"), "n", "ids") for name, rows in left.items()]
    return reduce(DataFrame.unionByName, counted).filter("n > 0")


_ROLES = "' ' || o_orderpriority || ', ,ROLE_' || o_orderstatus || ','"


@query(f"select o_orderkey, array_to_string(list_transform(list_filter(list_transform(string_split({_ROLES}, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: case when starts_with(x, 'ROLE_') then x else 'ROLE_' || x end), '|') as roles, o_orderkey % 2 = 0 as locked from orders")
def role_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """OP-ROLES, FLT19, FN-PREFIX"""
    users = load(spark, sf, "orders").select(F.col("o_orderkey").alias("username"), F.lit("x").alias("password"), F.concat(F.lit(" "), "o_orderpriority", F.lit(", ,ROLE_"), "o_orderstatus", F.lit(",")).alias("roles"), (F.col("o_orderkey") % 2 == 1).alias("enabled"))
    return ledger.authorities(users).select(F.col("username").alias("o_orderkey"), F.array_join("authorities", "|").alias("roles"), "locked")


# --- Ingest ---------------------------------------------------------------------------------


@query(
    with_views(
        "select w.name, case when w.id % 2 = 0 then 'stored' else 'PvP ' || cast(w.id as varchar) end as pvp_type, w.location, case when w.id % 3 = 0 then 'old record' when w.location <> 'AFRICA' then 'record ' || cast(w.id as varchar) end as online_record from worlds w "
        "union all select 'Fresh#' || cast(r_regionkey as varchar), 'PvP new', 'EU', 'record new' from region",
        "worlds",
    )
)
def upsert_worlds(spark: SparkSession, sf: str) -> DataFrame:
    """SNK3, AGG3, D6, D7: stored attributes stay, null ones are filled, new worlds are added"""
    w = view(spark, sf, "worlds")
    none = F.lit(None).cast("string")
    stored = w.select("id", "name", F.when(F.col("id") % 2 == 0, "stored").alias("pvp_type"), "location", F.when(F.col("id") % 3 == 0, "old record").alias("online_record"), F.lit(None).cast("date").alias("creation_date"), none.alias("transfer_type"), none.alias("game_world_type"))
    fresh = load(spark, sf, "region").select(F.concat(F.lit("Fresh#"), F.col("r_regionkey").cast("string")).alias("name"))
    overview = w.select("name", F.concat(F.lit("PvP "), F.col("id").cast("string")).alias("pvp_type"), F.lit("elsewhere").alias("location")).unionByName(fresh.select("name", F.lit("PvP new").alias("pvp_type"), F.lit("EU").alias("location")))
    facts = w.filter("location <> 'AFRICA'").select("name", F.concat(F.lit("record "), F.col("id").cast("string")).alias("online_record")).unionByName(fresh.select("name", F.lit("record new").alias("online_record")))
    pages = facts.select("name", _ntz(AS_OF).alias("fetched_at"), none.alias("pvp_type"), "online_record", F.lit(None).cast("date").alias("creation_date"), none.alias("transfer_type"), none.alias("game_world_type"))
    return ingest.upsert_worlds(stored, overview, pages).select("name", "pvp_type", "location", "online_record")


def _page_players(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as world pages: a page per order with its lines' suppliers as players."""
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.format_string("Supplier#%09d", "l_suppkey"))).alias("players"))
    none = F.lit(None).cast("string")
    orders = load(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(F.format_string("NATION_%d", F.col("o_orderkey") % 25).alias("name"), (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey").cast("decimal(18,6)"))).alias("fetched_at"), F.size("players").alias("players_online"), none.alias("pvp_type"), none.alias("online_record"), F.lit(None).cast("date").alias("creation_date"), none.alias("transfer_type"), none.alias("game_world_type"), "players")


def _known_players(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("character_id"), F.col("s_name").alias("name"), F.lit(True).alias("active"), F.lit(None).cast("timestamp_ntz").alias("inactive_date"))


def _pass(spark: SparkSession, sf: str) -> Changes:
    none = F.lit(None).cast("string")
    w = view(spark, sf, "worlds")
    stored = w.select("id", "name", none.alias("pvp_type"), "location", none.alias("online_record"), F.lit(None).cast("date").alias("creation_date"), none.alias("transfer_type"), none.alias("game_world_type"))
    former = spark.createDataFrame([], "name string, former_names string")
    return ingest.world_pass(stored, _known_players(spark, sf), w.select("name", none.alias("pvp_type"), "location"), _page_players(spark, sf), former, _ntz(AS_OF), scratch(spark, "pass"))


_PAGES = "select o_orderkey % 25 as world_id, o_orderdate + to_seconds(o_orderkey) as scrape_time, count(distinct l_suppkey) as players_online from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate"


@query(f"select cast(world_id as bigint) as world_id, scrape_time, cast(players_online as int) as players_online from ({_PAGES})")
def pass_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """OP-WORLD, SNK1, OP-STAMP"""
    return _pass(spark, sf)["scrapes"].select("world_id", "scrape_time", "players_online")


@query("select world_id, scrape_time, count(*) as players, cast(count_if(s_nationkey < 12) as bigint) as known from (select distinct o_orderkey % 25 as world_id, o_orderdate + to_seconds(o_orderkey) as scrape_time, l_suppkey, s_nationkey from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey) group by all")
def pass_players(spark: SparkSession, sf: str) -> DataFrame:
    """OP-WORLD, SNK2, AGG4, JOIN6: players per snapshot, and how many were known before"""
    out = _pass(spark, sf)
    known = load(spark, sf, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("character_id"), F.lit(1).alias("one"))
    # Two pages of a world at one time are one snapshot: same id, players of both.
    scrapes = out["scrapes"].select(F.col("id").alias("scrape_id"), "world_id", "scrape_time").distinct()
    joined = out["scrape_players"].join(scrapes, "scrape_id").join(known, "character_id", "left")
    return joined.groupBy("world_id", "scrape_time").agg(F.count("*").alias("players"), F.count("one").alias("known"))


@query("select s_name as name, true as active from supplier where s_nationkey < 12 union select 'Supplier#' || lpad(cast(l_suppkey as varchar), 9, '0'), true from lineitem")
def pass_names(spark: SparkSession, sf: str) -> DataFrame:
    """OP-WORLD, SNK4: unknown players get a character and a first name"""
    return merged(_known_players(spark, sf), _pass(spark, sf)["character_names"]).select("name", "active")


def _returning(spark: SparkSession, sf: str) -> str:
    """A folder of tables in which every third customer has given up its name before the horizon and bears another one now."""
    folder, key = scratch(spark, "returning"), F.col("c_custkey")
    c = load(spark, sf, "customer").select(key, "c_name", (key % 3 == 0).alias("gone"))
    now = c.select((2 * key).alias("id"), key.alias("character_id"), F.concat(F.when(F.col("gone"), "Now ").otherwise(""), "c_name").alias("name"), F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("inactive_date"))
    was = c.filter("gone").select((2 * key + 1).alias("id"), key.alias("character_id"), F.col("c_name").alias("name"), F.lit(False).alias("active"), F.lit("1999-01-01 00:00:00").cast("timestamp").alias("inactive_date"))
    names = now.unionByName(was)
    none = F.lit(None).cast("string")
    worlds = view(spark, sf, "worlds").select("id", "name", none.alias("pvp_type"), "location", none.alias("online_record"), F.lit(None).cast("date").alias("creation_date"), none.alias("transfer_type"), none.alias("game_world_type"))
    Tables(spark, folder).commit("start", Changes(replaced={"worlds": worlds, "character_names": names}, marks={"characters": ingest.last_character(names)}))
    return folder


@query(
    "select c_name as name, true as active, c_custkey % 3 = 0 as is_new, cast(1 as bigint) as active_names from customer "
    "union all select 'Now ' || c_name, true, false, 1 from customer where c_custkey % 3 = 0 union all select c_name, false, false, 1 from customer where c_custkey % 3 = 0"
)
def returning_names(spark: SparkSession, sf: str) -> DataFrame:
    """OP-WORLD, OP-RESOLVE, OP-ACTIVE, SNK4, SNK5: two passes in which names come back on other characters, one of them run twice"""
    folder, none = _returning(spark, sf), F.lit(None).cast("string")
    before = Tables(spark, folder).mark("characters")
    c = load(spark, sf, "customer").join(view(spark, sf, "worlds").select(F.col("id").alias("c_nationkey"), F.col("name").alias("world")), "c_nationkey")
    overview = view(spark, sf, "worlds").select("name", none.alias("pvp_type"), "location")
    former = spark.createDataFrame([], "name string, former_names string")
    for at in (AS_OF, AS_OF, "2000-12-02 00:00:00"):
        players = c.groupBy(F.col("world").alias("name")).agg(F.collect_list("c_name").alias("players"))
        pages = players.select("name", F.lit(at).cast("timestamp").alias("fetched_at"), F.size("players").alias("players_online"), *[none.alias(a) for a in ("pvp_type", "online_record", "transfer_type", "game_world_type")], F.lit(None).cast("date").alias("creation_date"), "players")
        ingest.run_world_pass(spark, folder, f"pass at {at}", overview, pages, former, F.lit(at).cast("timestamp"))
    names = Tables(spark, folder).read("character_names")
    held = names.groupBy("character_id").agg(F.count_if("active").alias("active_names"))
    return names.join(held, "character_id").select("name", "active", (F.col("character_id") > before).alias("is_new"), "active_names")


@query(
    "select name, count(*) as records, is_new, cast(1 as bigint) as names from (select c_name as name, c_custkey % 3 = 0 as is_new from customer join orders on o_custkey = c_custkey "
    "union all select 'Now ' || c_name, false from customer join orders on o_custkey = c_custkey where c_custkey % 3 = 0) group by name, is_new"
)
def highscores_of_returning_names(spark: SparkSession, sf: str) -> DataFrame:
    """OP-HS, SNK6: a run over lists with names that were given up and their former bearers; each has a character of its own"""
    folder = _returning(spark, sf)
    before = Tables(spark, folder).mark("characters")
    rows = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("*", F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array("c_name", F.concat(F.lit("Now "), "c_name"))).otherwise(F.array("c_name"))).alias("name"))
    lists = rows.select(F.format_string("NATION_%d", F.col("c_custkey") % 25).alias("world"), F.lit("EXPERIENCE").alias("category"), F.lit(1).alias("vocation_id"), F.lit(1).alias("page"), F.col("o_orderkey").cast("int").alias("rank"), "name", F.floor("o_totalprice").cast("bigint").alias("value"))
    tables = ingest.run_highscores(spark, folder, "run", lists, F.lit(AS_OF).cast("timestamp"))
    names = tables.read("character_names").filter("active")
    shared = names.groupBy("character_id").agg(F.count("*").alias("names"))
    counted = tables.read("character_statrecords").groupBy("character_id").agg(F.count("*").alias("records"))
    return counted.join(names, "character_id").join(shared, "character_id").select("name", "records", (F.col("character_id") > before).alias("is_new"), "names")


def _snapshots_in_batches(spark: SparkSession, sf: str) -> Tables:
    """Stored snapshots that came in four batches, out of order in time; one came twice."""
    folder = scratch(spark, "snapshots")
    rows = view(spark, sf, "scrapes").withColumn("scrape_time", F.col("scrape_time").cast("timestamp"))
    for number in (0, 2, 1, 2, 3):
        batch = rows.filter(F.col("id") % 4 == number)
        tables = run(spark, folder, f"batch {number}", lambda stored: ingest.with_latest(stored, Changes(appended={"scrapes": batch})))  # noqa: B023  used at once
    return tables


@query(with_views(f"select world_id, players_online, scrape_time from ({LATEST})", "scrapes"))
def latest_maintained(spark: SparkSession, sf: str) -> DataFrame:
    """AGG2, A1 to A3: the stored last snapshot per world, updated by each batch"""
    found = _snapshots_in_batches(spark, sf).read("scrapes_latest")
    return found.select("world_id", "players_online", F.col("scrape_time").cast("timestamp_ntz").alias("scrape_time"))


@query(with_views(f"select scrape_time, players_online from scrapes s join worlds w on w.id = s.world_id where w.name = '{WORLD}' and scrape_time between timestamp '{FROM}' and timestamp '{TO}'", "worlds", "scrapes"))
def stored_world_history(spark: SparkSession, sf: str) -> DataFrame:
    """A4, FLT2: from the partitions of one world and two days"""
    world = view(spark, sf, "worlds").filter(F.col("name") == WORLD).first()["id"]
    start, end = F.lit(FROM).cast("timestamp"), F.lit(TO).cast("timestamp")
    rows = _snapshots_in_batches(spark, sf).of_key("scrapes", world, (start, end)).filter(F.col("scrape_time").between(start, end))
    return rows.orderBy("scrape_time", "id").select(F.col("scrape_time").cast("timestamp_ntz").alias("scrape_time"), "players_online")


@query(with_views(f"select date, value, rank, world_id from stats where character_id = 4 and category = '{CATEGORY}'", "stats"))
def stored_stat_history(spark: SparkSession, sf: str) -> DataFrame:
    """A6, FLT8, SNK6: from the partition of one character and category"""
    records = view(spark, sf, "stats").withColumns({"scraped_at": F.lit(AS_OF).cast("timestamp"), "vocation_id": F.lit(1)})
    tables = Tables(spark, scratch(spark, "records")).commit("run", Changes(appended={"character_statrecords": records}))
    return tables.of_key("character_statrecords", 4).filter(F.col("category") == CATEGORY).orderBy("date", "id").select("date", "value", "rank", "world_id")


@query("select o_orderpriority as category, date '2000-12-01' as date, cast(floor(o_totalprice) as bigint) as value, cast(o_orderkey as int) as rank, cast(o_custkey % 25 as bigint) as world_id, c.c_custkey % 3 <> 0 as known from orders join customer c on c_custkey = o_custkey")
def highscore_records(spark: SparkSession, sf: str) -> DataFrame:
    """OP-HS, SNK6, D4, D5, D16: only active names are known"""
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    rows = load(spark, sf, "orders").join(customers, "o_custkey").select(F.format_string("NATION_%d", F.col("o_custkey") % 25).alias("world"), F.col("o_orderpriority").alias("category"), F.lit(1).alias("vocation_id"), F.lit(1).alias("page"), F.col("o_orderkey").cast("int").alias("rank"), "name", F.floor("o_totalprice").cast("bigint").alias("value"))
    names = view(spark, sf, "character_names")
    out = ingest.highscore_run(view(spark, sf, "worlds"), names, rows, _ntz(AS_OF), scratch(spark, "highscores"))
    known = names.select("character_id", F.lit(True).alias("k")).distinct()
    return out["character_statrecords"].join(known, "character_id", "left").select("category", "date", "value", "rank", "world_id", F.coalesce("k", F.lit(False)).alias("known"))


@query("select rule, cast(n as bigint) as n from (select 'character_id is null' as rule, count_if(o_custkey is null) as n from orders union all select 'category is null', count_if(o_orderpriority is null) from orders union all select 'category is not allowed', count(*) from orders union all select 'world_id is null', 0 union all select 'date is null', count_if(o_orderdate is null) from orders union all select 'world_id is not in worlds', count_if(o_custkey % 30 >= 25) from orders)")
def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    """NOT NULL, CHECK and REFERENCES as counts"""
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("character_id"), F.col("o_orderpriority").alias("category"), F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 30).alias("world_id"))
    return schemas.violations("character_statrecords", rows, {"worlds": view(spark, sf, "worlds")})


@query("select 'name is null' as rule, cast(0 as bigint) as n union all select 'name repeats', count(*) from (select c_mktsegment from customer group by 1 having count(*) > 1)")
def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    """UNIQUE as a count of repeated keys"""
    return schemas.violations("worlds", load(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")))


# --- Functions ------------------------------------------------------------------------------


@query("select page_id, coalesce(try_cast(regexp_replace(url, '[^0-9]', '', 'g') as int), 0) as i, coalesce(try_cast(regexp_replace(url || cast(page_id as varchar), '[^0-9]', '', 'g') as bigint), 0) as l from pages")
def digits_or_zero(spark: SparkSession, sf: str) -> DataFrame:
    """FN-INT, FN-LONG"""
    p = load(spark, sf, "pages")
    return p.select("page_id", C.digits_int(F.col("url")).alias("i"), C.digits_long(F.concat("url", F.col("page_id").cast("string"))).alias("l"))


@query("select o_orderkey, cast(cast(o_custkey as varchar) as int) as n from orders")
def strict_number(spark: SparkSession, sf: str) -> DataFrame:
    """FN-STRICT"""
    return load(spark, sf, "orders").select("o_orderkey", C.strict_int(F.col("o_custkey").cast("string")).alias("n"))


@query("select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month from orders")
def month_year(spark: SparkSession, sf: str) -> DataFrame:
    """FN-MONTH"""
    return load(spark, sf, "orders").select("o_orderkey", C.month_year(F.date_format("o_orderdate", "MMMM yyyy")).alias("month"))


_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 = 0 then '' when microsecond(ts) % 1000 = 0 then strftime(ts, '.%g') else strftime(ts, '.%f') end || 'Z'"


@query(f"select event_id, {_ISO} as iso from events")
def iso_instant(spark: SparkSession, sf: str) -> DataFrame:
    """FN-ISO, PRJ3"""
    return load(spark, sf, "events").select("event_id", C.iso_instant(F.col("ts")).alias("iso"))


@query("select o_orderkey, cast(cast(o_orderdate as date) as varchar) as date from orders")
def iso_date(spark: SparkSession, sf: str) -> DataFrame:
    """FN-DATE, PRJ6"""
    return load(spark, sf, "orders").select("o_orderkey", C.iso_date(F.to_date("o_orderdate")).alias("date"))


@query("select event_id, make_timestamp(1700000000000000 + event_id * 1000) as t, timestamp '2024-01-05 00:00:00' as s from events")
def epoch_millis(spark: SparkSession, sf: str) -> DataFrame:
    """FN-PARSE"""
    at = C.from_epoch_millis(F.lit(1_700_000_000_000) + F.col("event_id"))
    return load(spark, sf, "events").select("event_id", at.cast("timestamp_ntz").alias("t"), C.parse_instant(F.lit("2024-01-05T00:00:00Z")).cast("timestamp_ntz").alias("s"))


@query("select o_orderkey, o_orderdate - interval 6 months as cutoff, o_orderdate - interval 86400 seconds as start, o_orderdate + interval 900 seconds as access_until, o_orderdate + interval 1209600 seconds as refresh_until from orders")
def instants(spark: SparkSession, sf: str) -> DataFrame:
    """FN-HORIZON, FN-NOW, FN-TTL"""
    d = F.col("o_orderdate")
    return load(spark, sf, "orders").select("o_orderkey", C.horizon(d).alias("cutoff"), C.default_range(d)[0].alias("start"), C.expires_at(d, C.ACCESS_TTL_MS).alias("access_until"), C.expires_at(d, C.REFRESH_TTL_MS).alias("refresh_until"))


@query("select c_custkey, coalesce(nullif(trim(case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '  ' else c_mktsegment end), ''), 'USER') as roles from customer")
def roles_default(spark: SparkSession, sf: str) -> DataFrame:
    """FN-DEFROLE"""
    k = F.col("c_custkey")
    return load(spark, sf, "customer").select("c_custkey", C.default_roles(F.when(k % 3 == 0, None).when(k % 3 == 1, F.lit("  ")).otherwise(F.col("c_mktsegment"))).alias("roles"))


@query("select c_custkey, case when c_custkey % 2 = 0 then c_name end as token from customer")
def bearer(spark: SparkSession, sf: str) -> DataFrame:
    """FN-BEARER"""
    header = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Bearer ").otherwise("Basic "), F.col("c_name"))
    return load(spark, sf, "customer").select("c_custkey", C.bearer_token(header).alias("token"))


_LISTED = "o_orderkey % 16"


@query(f"select o_orderkey, code from orders left join (values " + ", ".join(f"({k - 1}, {k})" for k in range(1, len(C.CATEGORIES) + 1)) + f") t(k, code) on k = {_LISTED}")
def category_codes(spark: SparkSession, sf: str) -> DataFrame:
    """FN-CODE: each order's category, by its key, as the site's code; every sixteenth has one that the site doesn't know"""
    category = F.get(F.array(*map(F.lit, (*C.CATEGORIES, "NONE"))), F.expr(_LISTED).cast("int"))
    return load(spark, sf, "orders").select("o_orderkey", C.category_code(category).alias("code"))


@query("select event_id, trim(regexp_replace(' ' || event_type || chr(10) || ' x ', '\\s+', ' ', 'g')) as clean, trim(event_type) = '' as blank, lower(event_type) = 'click' as same, contains(event_type, 'i') as labelled from events")
def text_tests(spark: SparkSession, sf: str) -> DataFrame:
    """FN-TRIM, FN-BLANK, FN-CONTAINS, FLT15"""
    x = F.col("event_type")
    return load(spark, sf, "events").select("event_id", C.clean(F.concat(F.lit(" "), x, F.lit("\n x "))).alias("clean"), C.is_blank(x).alias("blank"), C.equals_ignoring_case(x, "Click").alias("same"), C.has_label(x, "i").alias("labelled"))


@query("select c_custkey, array_to_string(list_filter(list_transform(string_split(c_name || ', ,' || c_mktsegment || ',', ','), lambda x: trim(x)), lambda x: x <> ''), '|') as parts from customer")
def split_names(spark: SparkSession, sf: str) -> DataFrame:
    """FN-SPLIT"""
    return load(spark, sf, "customer").select("c_custkey", F.array_join(C.split_names(F.concat("c_name", F.lit(", ,"), "c_mktsegment", F.lit(","))), "|").alias("parts"))


@query(f"select n_nationkey, '{BASE}?subtopic=worlds&world=' || n_name as world_url, '{BASE}?name=' || n_name || '+%26+x' as character_url, '{BASE}?subtopic=highscores&world=' || n_name || '&beprotection=-1&profession=2&category=6&currentpage=' || cast(n_nationkey as varchar) as list_url from nation")
def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    """SRC9"""
    base, n = F.lit(BASE), F.col("n_name")
    return load(spark, sf, "nation").select("n_nationkey", S.world_url(base, n).alias("world_url"), S.character_url(base, F.concat(n, F.lit(" & x"))).alias("character_url"), S.highscore_url(base, n, F.lit(2), F.lit("EXPERIENCE"), F.col("n_nationkey")).alias("list_url"))


@query("select c_custkey, name, promotion_name from customer left join (values " + ", ".join(f"({k}, '{n}', '{p}')" for k, (n, p) in enumerate(S.VOCATIONS, 1)) + ") t(id, name, promotion_name) on id = c_custkey % 7")
def seeded_vocations(spark: SparkSession, sf: str) -> DataFrame:
    """SRC8, JOIN5: the seeded vocations of customers; two of seven have none"""
    own = load(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 7).cast("long").alias("id"))
    return own.join(F.broadcast(S.vocations(spark)), "id", "left").select("c_custkey", "name", "promotion_name")


@query(with_views(f"select '{{\"world\":\"' || w.name || '\",\"playersOnline\":' || cast(coalesce(l.players_online, 0) as varchar) || '}}' as json from worlds w left join ({LATEST}) l on l.world_id = w.id", "worlds", "scrapes"))
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SNK12, PRJ1, PRJ2, FN-JSON"""
    rows = worlds_online(spark, sf)
    return rows.select(C.to_json("world", F.col("players_online").alias("playersOnline")).alias("json"))


@query(with_views(f"select w.name, coalesce(l.players_online, 0) as playersOnline from worlds w left join ({LATEST}) l on l.world_id = w.id", "worlds", "scrapes"))
def graph_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SNK13, PRJ2"""
    return worlds_online(spark, sf).select(F.col("world").alias("name"), F.col("players_online").alias("playersOnline"))


_VOCATION_OF = {segment: k for k, segment in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), 1)}


@query(
    with_views(
        f"select c.id, n.name, cast(c.id % 100 as int) as level, v.id as vocationId, v.name as vocation, cast(null as varchar) as residence from character_names n join characters c on c.id = n.character_id left join (select * from (values "
        + ", ".join(f"({k}, '{n}', '{s}')" for (s, k), (n, _) in zip(_VOCATION_OF.items(), S.VOCATIONS, strict=True) if k != 3)
        + f") t(id, name, segment)) v on v.segment = c.vocation where {RECENT}",
        "characters",
        "character_names",
    )
)
def character_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ4, PRJ5, JOIN5, D9: the answers for all names; a segment stands for a vocation, one of them is unknown, and so are residences"""
    c = view(spark, sf, "characters")
    known = F.coalesce(*[F.when(F.col("vocation") == s, F.lit(k)) for s, k in _VOCATION_OF.items() if k != 3]).cast("long")
    characters = c.select("id", known.alias("vocation_id"), (F.col("id") % 100).cast("int").alias("level"))
    found = identity.by_any_name(view(spark, sf, "character_names"), characters, _ntz(CUTOFF))
    return answers(found, S.vocations(spark)).select("id", "name", "level", "vocationId", "vocation", "residence")


# --- Pages ----------------------------------------------------------------------------------


@query("select page_id, replace(replace(replace(replace(replace(replace(trim(regexp_replace(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&') as title from pages")
def page_title(spark: SparkSession, sf: str) -> DataFrame:
    """FN-CSS: the title of whole pages"""
    return P.titles(load(spark, sf, "pages"), "page_id")


@query("select page_id, count(*) as n, count(distinct href) as targets from (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages) group by page_id")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """FN-CSS: links of whole pages"""
    found = P.links(load(spark, sf, "pages"), "page_id")
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("href").alias("targets"))


# Pages of the four kinds, built from the star tables, so that what the parsers find is known.


def _tag(name: str, *content, attributes: str = ""):
    return F.concat(F.lit(f"<{name}{attributes and ' ' + attributes}>"), *[F.lit(c) if isinstance(c, str) else c for c in content], F.lit(f"</{name}>"))


def _row(*cells):
    return _tag("tr", *[_tag("td", c) for c in cells])


def _joined(*order, row):
    """The rows of a page in the order of ``order``, as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("row")))), lambda r: r["row"]), "")


def _grouped(number):
    """A number as pages write it, with thousands set apart."""
    return F.format_number(number, 0)


@query("select r_name as region, n_name as name, 'PvP ' || cast(n_nationkey % 3 as varchar) as pvp_type, 'Land & ' || r_name as location, cast(n_nationkey * 1234 as int) as players_online from nation join region on n_regionkey = r_regionkey")
def overview_pages(spark: SparkSession, sf: str) -> DataFrame:
    """SRC1, FLT14, FN-CSS, FN-INT: an overview per region, with a header, a short row and a row without a name"""
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = _row(_tag("a", F.col("n_name"), attributes='href="/w"'), _grouped(F.col("n_nationkey") * 1234), F.concat(F.lit("Land &amp; "), F.col("r_name")), F.concat(F.lit(" PvP  "), (F.col("n_nationkey") % 3).cast("string")))
    body = n.groupBy(F.col("r_name").alias("region")).agg(_joined("n_nationkey", row=row).alias("rows"))
    table = _tag("table", _row("World", "Online", "Location", "PvP Type"), F.col("rows"), _row("", "5", "x", "y"), _row("short", "1", "x"), attributes='class="TableContent wide"')
    outside = _tag("table", _row("Outside", "1", "x", "y"), attributes='class="TableContent"')
    pages = body.select("region", _tag("html", _tag("body", _tag("div", table, attributes='class="TableContentContainer"'), outside)).alias("html"))
    return P.world_list(pages, "region").select("region", "name", "pvp_type", "location", "players_online")


def _world_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A world page per nation; its suppliers are online. Containers are nested, and some worlds lack a fact."""
    s, k = load(spark, sf, "supplier"), F.col("n_nationkey")
    player = _row(_tag("a", F.col("s_name"), attributes='href="/c"'), F.col("s_suppkey").cast("string"), "Knight")
    online = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(_joined("s_suppkey", row=player).alias("rows"), F.count("*").alias("n"))
    n = load(spark, sf, "nation").join(online, "n_nationkey", "left")
    facts = F.concat(
        _row(P.PLAYERS_ONLINE, _grouped(F.coalesce("n", F.lit(0)) + 1000 * k)),
        _row(P.CREATION_DATE, F.date_format(F.make_date(F.lit(1997), k % 12 + 1, F.lit(1)), "MMMM yyyy")),
        F.when(k % 4 != 0, _row(P.ONLINE_RECORD, F.concat(F.lit("record "), k.cast("string")))).otherwise(F.lit("")),
        _row(P.PVP_TYPE, F.concat(F.lit("Type "), k.cast("string"))),
        _row(P.GAME_WORLD_TYPE, "Regular"),
    )

    def inner(*content):
        return _tag("div", _tag("table", *content), attributes='class="InnerTableContainer"')

    one = _tag("table", _tag("tr", _tag("td", inner(facts))), attributes='class="Table1"')
    two = _tag("table", _tag("tr", _tag("td", inner(_row("Name [sort]", "Level [sort]", "Vocation [sort]"), F.coalesce("rows", F.lit("")), _row("no link", "1", "Druid")))), attributes='class="Table2"')
    return n.select("n_name", _tag("div", one, two, attributes='class="InnerTableContainer"').alias("html"))


_ONLINE = "select n_nationkey, n_name, count(s_suppkey) as n, coalesce(string_agg(s_name, '|' order by s_suppkey), '') as players from nation left join supplier on s_nationkey = n_nationkey group by all"


@query(
    f"select n_name, cast(n + 1000 * n_nationkey as int) as players_online, make_date(1997, cast(n_nationkey % 12 + 1 as int), 1) as creation_date, case when n_nationkey % 4 <> 0 then 'record ' || cast(n_nationkey as varchar) end as online_record, "
    f"'Type ' || cast(n_nationkey as varchar) as pvp_type, 'Regular' as game_world_type, players from ({_ONLINE})"
)
def world_pages(spark: SparkSession, sf: str) -> DataFrame:
    """SRC2, FLT15, FLT16, FN-CSS, FN-MONTH: facts and players of nested tables"""
    found = P.world_page(_world_pages(spark, sf), "n_name")
    return found.select("n_name", "players_online", "creation_date", "online_record", "pvp_type", "game_world_type", F.array_join("players", "|").alias("players"))


@query(f"select n_name, n as names from ({_ONLINE})")
def names_per_page(spark: SparkSession, sf: str) -> DataFrame:
    """AGG4: names listed on each page"""
    return P.world_page(_world_pages(spark, sf), "n_name").select("n_name", F.size("players").cast("long").alias("names"))


@query("select c_name as name, case when c_custkey % 3 = 0 then 'Old ' || cast(c_custkey as varchar) || ', Older' else c_name end as former_names from customer")
def former_name_pages(spark: SparkSession, sf: str) -> DataFrame:
    """SRC3, FLT17: a character page per customer, every third one with former names"""
    c, k = P.dealt(load(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey"), F.col("c_custkey")
    former = F.when(k % 3 == 0, _row(P.FORMER_NAMES, F.concat(F.lit("Old "), k.cast("string"), F.lit(",  Older")))).otherwise(F.lit(""))
    pages = c.select(F.col("c_name").alias("name"), _tag("table", _row("Name:", F.col("c_name")), former, _row("Level:", "8"), attributes='class="TableContent"').alias("html"))
    return P.former_names(pages, "name")


@query("select c_mktsegment as list, cast(c_custkey as int) as rank, c_name as name, cast(c_custkey * 1234567 as bigint) as value from customer where c_custkey > 0")
def highscore_pages(spark: SparkSession, sf: str) -> DataFrame:
    """SRC4, FN-LONG: a list per segment in pages of about 50 rows, each with a header and rows of rank 0, without a name, and too short"""
    key = F.col("c_custkey")
    c = P.dealt(load(spark, sf, "customer").select(F.col("c_mktsegment").alias("list"), F.floor(key / KEYS_PER_PAGE).alias("page"), "c_custkey", "c_name"), "list", "page")
    row = _row(key.cast("string"), F.col("c_name"), _grouped(key * 1234567))
    lists = c.groupBy("list", "page").agg(_joined("c_custkey", row=row).alias("rows"))
    pages = lists.select("list", _tag("table", _row("Rank", "Name", "Points"), F.col("rows"), _row("0", "Zero", "1"), _row("1", " ", "1"), _row("2", "short"), attributes='class="TableContent"').alias("html"))
    return P.highscores(pages, "list")


@query("select c_custkey as id, c_name as username, c_mktsegment as roles from customer where c_name in ('Customer#000000003', 'Customer#000000005')")
def user_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """FLT13"""
    users = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("roles"))
    return ledger.user_by_name(users, "Customer#000000003", "Customer#000000005", "nobody")


@query("select cast(c_custkey as bigint) as id, case when c_custkey % 10 = 0 then 'merged' else c_name end as username, c_mktsegment as roles, true as in_ranges, true as filtered_there from customer where c_mktsegment = 'BUILDING' and c_custkey > 20 union all select n_nationkey + 1000000, n_name, 'BUILDING', true, true from nation")
def jdbc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """SRC7, SNK7: users in a database (the embedded one that comes with Spark), merged by key, read in ranges that it gives, filtered there"""
    database = jdbc.Embedded(spark, scratch(spark, "database"))
    users = load(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("roles"))
    database.write(users.repartition(4), database.url, "users", "id")
    fresh = load(spark, sf, "nation").select((F.col("n_nationkey") + 1_000_000).cast("long").alias("id"), F.col("n_name").alias("username"), F.lit("BUILDING").alias("roles"))
    jdbc.upsert(users.filter("id % 10 = 0").withColumn("username", F.lit("merged")).unionByName(fresh), database.url, "users", "id", put=database.write, driver=database.DRIVER)
    rows = jdbc.read(spark, database.publish(), "users", range_rows=50, driver=database.DRIVER)
    found = rows.filter("roles = 'BUILDING' and id > 20")
    return found.withColumns({"in_ranges": F.lit(rows.rdd.getNumPartitions() > 1), "filtered_there": F.lit("EqualTo(roles,BUILDING)" in jdbc.pushed(found))})


@query(with_views("select id, name from worlds order by id limit 7 offset 14", "worlds"))
def third_page_of_worlds(spark: SparkSession, sf: str) -> DataFrame:
    """SNK14: paging in a total order"""
    return snapshots.page_of(view(spark, sf, "worlds").select("id", "name"), 7, 2, "id")


@query(with_views("select count(*) as n from worlds", "worlds"))
def count_of_worlds(spark: SparkSession, sf: str) -> DataFrame:
    """SNK14: how many there are"""
    return view(spark, sf, "worlds").agg(F.count("*").alias("n"))


def _questions(spark: SparkSession, sf: str) -> Questions:
    names = view(spark, sf, "character_names")
    characters = names.select(F.col("character_id").alias("id")).distinct().select("id", F.lit(1).cast("long").alias("vocation_id"), F.lit(None).cast("int").alias("level"))
    records = view(spark, sf, "stats").withColumn("category", F.lit(C.CATEGORIES[0]))
    return Questions(view(spark, sf, "worlds"), view(spark, sf, "scrapes"), characters, names, records, S.vocations(spark))


@query(with_views(f"select {_ISO.replace('ts', 'scrape_time')} as timestamp, players_online as playersOnline from scrapes s join worlds w on w.id = s.world_id where w.name = '{WORLD}' and scrape_time between timestamp '{FROM}' and timestamp '{TO}'", "worlds", "scrapes"))
def history_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ3: whole rows of a world's history"""
    return _questions(spark, sf).history(WORLD, datetime.fromisoformat(FROM).replace(tzinfo=timezone.utc), datetime.fromisoformat(TO).replace(tzinfo=timezone.utc)).select("timestamp", "playersOnline")


@query(with_views(f"select cast(s.date as varchar) as date, s.value, s.rank, w.name as world from stats s join worlds w on w.id = s.world_id where s.character_id = (select character_id from character_names where name = '{STAT_NAMES[0]}' and {RECENT})", "worlds", "character_names", "stats"))
def stat_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ6: whole rows of a character's record"""
    return _questions(spark, sf).stat_history(STAT_NAMES[0], C.CATEGORIES[0], datetime.fromisoformat(AS_OF).replace(tzinfo=timezone.utc))
