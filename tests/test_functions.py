import uuid
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from worldpulse.functions import columns as C
from worldpulse.operators.stats import read_pages
from worldpulse.schemas import violations

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, values, kind, expression):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r["y"] for r in rows.select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()]


def test_digits(spark):
    assert one(spark, ["1,234", "", "abc", "99999999999", "-5", None], "string", C.digits_int) == [1234, 0, 0, 0, 5, 0]
    assert one(spark, ["99999999999", "9" * 30], "string", C.digits_long) == [99999999999, 0]


@FEW
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_digits_of_any_text(spark, texts):
    texts = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]

    def plain(t):
        d = "".join(c for c in t if "0" <= c <= "9")
        return int(d) if d and int(d) < 2**31 else 0

    assert one(spark, texts, "string", C.digits_int) == [plain(t) for t in texts]


@FEW
@given(st.lists(st.datetimes(datetime(1990, 1, 1), datetime(2040, 1, 1)), min_size=1, max_size=20))
def test_iso(spark, times):
    def plain(t):
        f = "" if not t.microsecond else f".{t.microsecond // 1000:03d}" if t.microsecond % 1000 == 0 else f".{t.microsecond:06d}"
        return t.strftime("%Y-%m-%dT%H:%M:%S") + f + "Z"

    times = [*times, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 5000)]
    assert one(spark, times, "timestamp_ntz", C.iso_instant) == [plain(t) for t in times]


def test_strict_int_raises(spark):
    with pytest.raises(PySparkException):
        one(spark, ["1,234"], "string", C.strict_int)


def test_month_year(spark):
    assert one(spark, ["January 1997", "nonsense", None], "string", C.month_year) == [date(1997, 1, 1), None, None]


def test_roles(spark):
    assert one(spark, [" USER, ,ROLE_X,"], "string", C.role_names) == [["ROLE_USER", "ROLE_X"]]
    assert one(spark, [None, " ", "ADMIN"], "string", C.default_roles) == ["USER", "USER", "ADMIN"]


def test_bearer_and_codes(spark):
    assert one(spark, ["Bearer abc", "Basic abc", None], "string", C.bearer_token) == ["abc", None, None]
    assert one(spark, ["ACHIEVEMENTS", "BOSS_POINTS", "x"], "string", C.category_code) == [1, 15, None]


def test_pages_end_at_the_first_empty_one(spark):
    def pages(*numbers):
        return spark.createDataFrame([("w", "c", 1, p) for p in numbers], "world string, category string, vocation_id int, page int")

    assert read_pages(pages(*range(1, 26))).count() == 20
    assert {r["page"] for r in read_pages(pages(1, 2, 4)).collect()} == {1, 2}
    assert read_pages(pages(2, 3)).count() == 0


def test_violations(spark):
    rows = spark.createDataFrame([(1, None, "male"), (2, 1, "other"), (3, 9, None)], "id long, vocation_id long, sex string")
    vocations = spark.createDataFrame([(1,)], "id long")
    found = {r["rule"]: r["n"] for r in violations("characters", rows, {"vocations": vocations}).collect()}
    assert found == {"sex is not allowed": 1, "vocation_id is not in vocations": 1}


def test_token_ids_are_random_and_well_formed(spark):
    ids = [r["i"] for r in spark.range(50).select(C.token_id().alias("i")).collect()]
    assert len(set(ids)) == 50 and all(uuid.UUID(i).version == 4 for i in ids)
