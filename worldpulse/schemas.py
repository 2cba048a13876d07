"""The engine's tables, their allowed values, and a check that rows respect them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldpulse.functions.columns import CATEGORIES

SEXES = ("male", "female")


#: Each table's schema as DDL, which readers and ``createDataFrame`` take as it is.
TABLES = {
    "worlds": "id bigint, name string not null, pvp_type string, location string, online_record string, creation_date date, transfer_type string, game_world_type string",
    "scrapes": "id bigint, world_id bigint not null, scrape_time timestamp not null, players_online int not null",
    "vocations": "id bigint, name string, promotion_name string",
    "characters": "id bigint, sex string, vocation_id bigint, level int, achievement_points int, residence string, last_login timestamp, acc_status string, creation_date timestamp",
    "character_names": "id bigint, character_id bigint, name string not null, active boolean, inactive_date timestamp",
    "scrape_players": "id bigint, scrape_id bigint not null, character_id bigint not null",
    "character_worlds": "id bigint, character_id bigint not null, world_id bigint not null, active boolean, inactive_date timestamp",
    "character_deaths": "id bigint, character_id bigint not null, death_date timestamp, killed_by string",
    "guilds": "id bigint, name string not null, world_id bigint not null",
    "guild_characters": "id bigint, guild_id bigint not null, character_id bigint not null, created_at timestamp not null",
    "character_statrecords": "id bigint, character_id bigint not null, category string not null, date date not null, value bigint, rank int, world_id bigint not null, scraped_at timestamp not null, vocation_id bigint",
    "users": "id bigint, username string not null, password string not null, roles string not null, enabled boolean not null, created_at timestamp_ntz not null",
    "refresh_tokens": "id bigint, user_id bigint not null, token string not null, expires_at timestamp not null, created_at timestamp not null, revoked boolean not null",
    "token_blacklist": "id bigint, jti string not null, token string not null, revoked_at timestamp not null, reason string",
}

#: Keys that no two rows share. A name may come back after it was retired, so it's unique among active ones, and a
#: character has one active name.
UNIQUE = {
    "worlds": [("name",)],
    "character_names": [("name", "active"), ("character_id", "active")],
    "guilds": [("name",)],
    "users": [("username",)],
    "refresh_tokens": [("token",)],
    "token_blacklist": [("jti",)],
}
ALLOWED = {("characters", "sex"): SEXES, ("character_statrecords", "category"): CATEGORIES}
REFERENCES = {
    ("scrapes", "world_id"): "worlds",
    ("characters", "vocation_id"): "vocations",
    ("character_names", "character_id"): "characters",
    ("scrape_players", "scrape_id"): "scrapes",
    ("scrape_players", "character_id"): "characters",
    ("character_worlds", "character_id"): "characters",
    ("character_worlds", "world_id"): "worlds",
    ("character_deaths", "character_id"): "characters",
    ("guilds", "world_id"): "worlds",
    ("guild_characters", "guild_id"): "guilds",
    ("guild_characters", "character_id"): "characters",
    ("character_statrecords", "character_id"): "characters",
    ("character_statrecords", "world_id"): "worlds",
    ("refresh_tokens", "user_id"): "users",
}

#: The references whose rows go with what they refer to, and the one that may be null. All others refuse.
CASCADES = {
    ("character_statrecords", "world_id"): "cascade",
    ("refresh_tokens", "user_id"): "cascade",
    ("scrape_players", "scrape_id"): "cascade",
    ("characters", "vocation_id"): "set null",
}


def violations(name: str, rows: DataFrame, others: dict[str, DataFrame] | None = None, ids: bool = False) -> DataFrame:
    """``(rule, n)``: how many rows (or keys) break each rule of table ``name``; rules that hold are listed with 0.

    One pass counts nulls and values outside their set; a key's repeats and dangling references take one
    aggregation or anti-join each. ``others`` has the tables that references point to;
    ``ids`` asks whether ids repeat too.
    """
    needed = [f.split()[0] for f in TABLES[name].split(", ") if f.endswith("not null")]
    checks = {f"{c} is null": F.col(c).isNull() for c in needed if c in rows.columns}
    checks |= {f"{c} is not allowed": F.col(c).isNotNull() & ~F.col(c).isin(*values) for (t, c), values in ALLOWED.items() if t == name and c in rows.columns}
    spark = rows.sparkSession
    found = []
    if checks:
        counted = rows.agg(*[F.count_if(c).alias(rule) for rule, c in checks.items()])
        found.append(counted.unpivot([], list(checks), "rule", "n"))
    for keys in map(list, [*UNIQUE.get(name, []), *[("id",)] * ids]):
        if not set(keys) <= set(rows.columns):
            continue
        known = rows.filter("active") if "active" in keys else rows
        repeats = known.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
        found.append(repeats.agg(F.count("*").alias("n")).select(F.lit(f"{', '.join(keys)} repeats").alias("rule"), "n"))
    for (t, c), target in REFERENCES.items():
        if t == name and others and target in others:
            lost = rows.filter(F.col(c).isNotNull()).join(others[target].select(F.col("id").alias(c)), c, "left_anti")
            found.append(lost.agg(F.count("*").alias("n")).select(F.lit(f"{c} is not in {target}").alias("rule"), "n"))
    out = spark.createDataFrame([], "rule string, n bigint")
    for f in found:
        out = out.union(f.select("rule", F.col("n").cast("bigint")))
    return out
