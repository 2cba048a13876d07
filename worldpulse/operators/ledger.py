"""Users and tokens as ledger tables. Signing and hashing of passwords stay with the service in front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldpulse.functions.columns import REFRESH_TTL_MS, bearer_token, default_roles, expires_at, role_names
from worldpulse.operators.identity import new_id


def register(users: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Rows to append for ``requests(username, password, roles)`` with a username that nobody has; of repeated requests one."""
    fresh = requests.dropDuplicates(["username"]).join(users.select("username"), "username", "left_anti")
    return fresh.select(new_id(F.lit("user"), "username").alias("id"), "username", "password", default_roles(F.col("roles")).alias("roles"), F.lit(True).alias("enabled"), as_of.cast("timestamp_ntz").alias("created_at"))


def user_by_name(users: DataFrame, *usernames: str) -> DataFrame:
    """Whole user rows, by exact name."""
    return users.filter(F.col("username").isin(*usernames))


def authorities(users: DataFrame) -> DataFrame:
    """``(username, password, authorities, locked, disabled)``: a user that isn't enabled is both."""
    return users.select("username", "password", role_names(F.col("roles")).alias("authorities"), (~F.col("enabled")).alias("locked"), (~F.col("enabled")).alias("disabled"))


def issue(tokens: DataFrame, users: DataFrame, as_of: Column, ttl_ms: int = REFRESH_TTL_MS) -> DataFrame:
    """Refresh-token rows to append for ``tokens(username, token)`` of known users."""
    known = tokens.join(users.select("username", F.col("id").alias("user_id")), "username")
    return known.select(new_id(F.lit("token"), "token").alias("id"), "user_id", "token", expires_at(as_of, ttl_ms).alias("expires_at"), as_of.alias("created_at"), F.lit(False).alias("revoked"))


def current(refresh_tokens: DataFrame) -> DataFrame:
    """One row per token of an append-only ledger: revoked once any of its rows says so."""
    return refresh_tokens.groupBy("token").agg(F.min("id").alias("id"), F.max("user_id").alias("user_id"), F.max("expires_at").alias("expires_at"), F.min("created_at").alias("created_at"), F.bool_or("revoked").alias("revoked"))


def usable(refresh_tokens: DataFrame, as_of: Column) -> DataFrame:
    """Tokens that are neither revoked nor expired; one that expires right now still counts."""
    return refresh_tokens.filter(~F.col("revoked") & (F.col("expires_at") >= as_of))


def by_token(refresh_tokens: DataFrame, *tokens: str) -> DataFrame:
    return refresh_tokens.filter(F.col("token").isin(*tokens))


def unrevoked_of(refresh_tokens: DataFrame, user_id: int) -> DataFrame:
    return refresh_tokens.filter((F.col("user_id") == user_id) & ~F.col("revoked"))


def refusals(requests: DataFrame, refresh_tokens: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """``requests(token, type, username)`` with ``refused``: why a token can't be exchanged, or null if it can."""
    known = requests.join(users.select("username", F.lit(True).alias("_user")), "username", "left").join(refresh_tokens.select("token", "expires_at", "revoked"), "token", "left")
    why = F.when(~F.col("type").eqNullSafe(F.lit("refresh")), "invalid refresh token").when(F.col("_user").isNull(), "unknown user").when(F.col("revoked").isNull() | F.col("revoked"), "revoked").when(F.col("expires_at") < as_of, "expired")
    return known.select(*requests.columns, why.alias("refused"))


def rotate(exchanges: DataFrame, refresh_tokens: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """The token table after ``exchanges(token, type, username, new_token)``: accepted tokens are revoked, their successors issued."""
    accepted = refusals(exchanges, refresh_tokens, users, as_of).filter("refused is null")
    marked = refresh_tokens.join(accepted.select("token", F.lit(True).alias("_used")).distinct(), "token", "left")
    kept = marked.select(*[F.coalesce("_used", "revoked").alias(c) if c == "revoked" else F.col(c) for c in refresh_tokens.columns])
    return kept.unionByName(issue(accepted.select("username", F.col("new_token").alias("token")).distinct(), users, as_of).select(*refresh_tokens.columns))


def revoke(blacklist: DataFrame, revoked: DataFrame, as_of: Column) -> DataFrame:
    """Blacklist rows to append for ``revoked(jti, token, reason)``: one for each id that isn't listed yet."""
    fresh = revoked.filter("jti is not null").dropDuplicates(["jti"]).join(blacklist.select("jti"), "jti", "left_anti")
    return fresh.select(new_id(F.lit("jti"), "jti").alias("id"), "jti", "token", as_of.alias("revoked_at"), "reason")


def logout(headers: DataFrame, blacklist: DataFrame, as_of: Column) -> DataFrame:
    """Blacklist rows to append for ``headers(authorization, jti)``; other headers and unreadable tokens (null ids) are ignored."""
    given = headers.select("jti", bearer_token(F.col("authorization")).alias("token"), F.lit("logout").alias("reason")).filter("token is not null")
    return revoke(blacklist, given, as_of)


def blacklisted(tokens: DataFrame, blacklist: DataFrame) -> DataFrame:
    return tokens.join(blacklist.select("jti"), "jti", "left_semi")


def allowed(tokens: DataFrame, blacklist: DataFrame) -> DataFrame:
    return tokens.join(blacklist.select("jti"), "jti", "left_anti")


def purge(refresh_tokens: DataFrame, before: Column) -> DataFrame:
    """What is left once tokens that expired before an instant are deleted."""
    return refresh_tokens.filter(F.col("expires_at") >= before)


def without_parents(children: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """What a cascading delete of ``removed(id)`` leaves of ``children``."""
    return children.join(removed.select(F.col("id").alias(key)), key, "left_anti").select(*children.columns)
