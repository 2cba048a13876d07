from datetime import datetime

import pytest
from pyspark.sql import functions as F

from worldpulse.operators import ledger

NOW = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "ann", "x", " USER, ,ROLE_X,", True), (2, "bob", "x", "USER", False)], "id long, username string, password string, roles string, enabled boolean")


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame([(1, 1, "good", NOW, NOW, False), (2, 1, "gone", NOW, NOW, True), (3, 2, "old", datetime(2024, 4, 30), NOW, False)], "id long, user_id long, token string, expires_at timestamp, created_at timestamp, revoked boolean")


def test_refusals(spark, users, tokens):
    asked = spark.createDataFrame([("good", "refresh", "ann"), ("gone", "refresh", "ann"), ("old", "refresh", "bob"), ("none", "refresh", "ann"), ("good", "access", "ann"), ("good", "refresh", "eve")], "token string, type string, username string")
    found = {(r["token"], r["type"], r["username"]): r["refused"] for r in ledger.refusals(asked, tokens, users, F.lit(NOW)).collect()}
    assert found == {("good", "refresh", "ann"): None, ("gone", "refresh", "ann"): "revoked", ("old", "refresh", "bob"): "expired", ("none", "refresh", "ann"): "revoked", ("good", "access", "ann"): "invalid refresh token", ("good", "refresh", "eve"): "unknown user"}


def test_rotation(spark, users, tokens):
    asked = spark.createDataFrame([("good", "refresh", "ann", "next"), ("old", "refresh", "bob", "never")], "token string, type string, username string, new_token string")
    found = {r["token"]: r["revoked"] for r in ledger.rotate(asked, tokens, users, F.lit(NOW)).collect()}
    assert found == {"good": True, "gone": True, "old": False, "next": False}


def test_usable_and_purge(tokens):
    assert {r["token"] for r in ledger.usable(tokens, F.lit(NOW)).collect()} == {"good"}
    assert {r["token"] for r in ledger.purge(tokens, F.lit(NOW)).collect()} == {"good", "gone"}
    assert {r["token"] for r in ledger.unrevoked_of(tokens, 1).collect()} == {"good"}
    assert ledger.current(tokens.unionByName(tokens.withColumn("revoked", F.lit(True)))).filter("revoked").count() == 3


def test_blacklist_takes_an_id_once(spark):
    listed = spark.createDataFrame([("a", "t")], "jti string, token string")
    asked = spark.createDataFrame([("a", "Bearer 1"), ("b", "Bearer 2"), ("b", "Bearer 2"), ("c", "Basic 3"), (None, "Bearer 4")], "jti string, authorization string")
    assert [r["jti"] for r in ledger.logout(asked, listed, F.lit(NOW)).collect()] == ["b"]
    assert [r["jti"] for r in ledger.blacklisted(asked, listed).collect()] == ["a"]
    assert ledger.allowed(asked, listed).count() == 4


def test_register_and_authorities(spark, users):
    asked = spark.createDataFrame([("ann", "p", None), ("cid", "p", " "), ("cid", "p", " ")], "username string, password string, roles string")
    assert [(r["username"], r["roles"]) for r in ledger.register(users, asked, F.lit(NOW)).collect()] == [("cid", "USER")]
    found = {r["username"]: (r["authorities"], r["locked"]) for r in ledger.authorities(users).collect()}
    assert found == {"ann": (["ROLE_USER", "ROLE_X"], False), "bob": (["ROLE_USER"], True)}


def test_cascade(spark, users, tokens):
    left = ledger.without_parents(tokens, users.filter("username = 'ann'"), "user_id")
    assert [r["token"] for r in left.collect()] == ["old"]
