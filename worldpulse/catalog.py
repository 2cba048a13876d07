"""The engine's tables, derived from the star-schema test tables by plain SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The read model's views, in SQL that Spark and DuckDB both run. Worlds 20 to 24 have no snapshots on purpose.
VIEWS = {
    "worlds": "select cast(n_nationkey as bigint) as id, n_name as name, r_name as location from nation join region on n_regionkey = r_regionkey",
    "scrapes": "select cast(event_id as bigint) as id, cast(user_id % 20 as bigint) as world_id, ts as scrape_time, cast(floor(value) as int) as players_online from events",
    "characters": "select cast(c_custkey as bigint) as id, c_mktsegment as vocation, cast(c_nationkey as bigint) as world_id from customer",
    "character_names": "select cast(c.c_custkey as bigint) as id, cast(c.c_custkey as bigint) as character_id, c.c_name as name, (c.c_custkey % 3 <> 0) as active, case when c.c_custkey % 3 = 0 then max(o.o_orderdate) end as inactive_date from customer c left join orders o on o.o_custkey = c.c_custkey group by c.c_custkey, c.c_name",
    "stats": "select cast(o_orderkey as bigint) as id, cast(o_custkey as bigint) as character_id, o_orderpriority as category, cast(o_orderdate as date) as date, cast(floor(o_totalprice) as bigint) as value, cast(o_orderkey % 1000 + 1 as int) as rank, cast(c_nationkey as bigint) as world_id from orders join customer on c_custkey = o_custkey",
}

SOURCES = {"worlds": ("nation", "region"), "scrapes": ("events",), "characters": ("customer",), "character_names": ("customer", "orders"), "stats": ("orders", "customer")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the tables in ``sf_dir``; nothing is registered in the session's catalog."""
    return spark.sql(_placed(VIEWS[name], SOURCES[name]), **{t: load(spark, sf_dir, t) for t in SOURCES[name]})


def _placed(sql: str, tables: tuple[str, ...]) -> str:
    """``sql`` with its table names as arguments of ``spark.sql``; SQL names the tables only after from and join."""
    for t in tables:
        for word in ("from", "join"):
            sql = sql.replace(f"{word} {t} ", f"{word} {{{t}}} ")
        if sql.endswith(f"from {t}"):
            sql = sql.removesuffix(t) + f"{{{t}}}"
    return sql


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB, headed by the views it names."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names) + " " + sql
