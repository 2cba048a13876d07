"""Column expressions: text clean-up, number and date parsing, and the wire formats. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The score categories in the order of their site codes, 1 to 15.
CATEGORIES = (
    "ACHIEVEMENTS", "AXE_FIGHTING", "CHARM_POINTS", "CLUB_FIGHTING", "DISTANCE_FIGHTING",
    "EXPERIENCE", "FISHING", "FIST_FIGHTING", "GOSHNARS_TAINT", "LOYALTY_POINTS",
    "MAGIC_LEVEL", "SHIELDING", "SWORD_FIGHTING", "DROME_SCORE", "BOSS_POINTS",
)
HORIZON_MONTHS = 6
DEFAULT_RANGE_SECONDS = 86_400
ACCESS_TTL_MS, REFRESH_TTL_MS = 900_000, 1_209_600_000


def digits_int(x: Column) -> Column:
    """The digits of a text as an int; 0 without digits or beyond the type. A sign is lost, as in "-5" -> 5."""
    return F.coalesce(F.regexp_replace(x, "[^0-9]", "").try_cast("int"), F.lit(0))


def digits_long(x: Column) -> Column:
    return F.coalesce(F.regexp_replace(x, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def strict_int(x: Column) -> Column:
    """An int or, in ANSI mode, an error: "1,234" stops the job. :func:`digits_int` is the lenient form."""
    return x.cast("int")


def month_year(x: Column) -> Column:
    """"January 1997" as the month's first day; null if it can't be read."""
    return F.try_to_date(x, "MMMM yyyy") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(x, F.lit("MMMM yyyy")))


def clean(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def is_blank(x: Column) -> Column:
    return clean(x) == ""


def equals_ignoring_case(x: Column, word: str) -> Column:
    return F.lower(x) == word.lower()


def has_label(x: Column, label: str) -> Column:
    return F.contains(x, F.lit(label))


def split_names(x: Column) -> Column:
    """Comma-separated names, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, ","), lambda n: F.trim(n)), lambda n: n != "")


def role_names(x: Column) -> Column:
    """Comma-separated roles as authorities: trimmed, without empty ones, each with its prefix."""
    return F.transform(split_names(x), lambda r: F.when(F.startswith(r, F.lit("ROLE_")), r).otherwise(F.concat(F.lit("ROLE_"), r)))


def default_roles(x: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("USER"))


def bearer_token(header: Column) -> Column:
    """The token of an authorisation header; null for other headers."""
    return F.when(F.startswith(header, F.lit("Bearer ")), F.substring(header, 8, 2**31 - 1))


def category_code(x: Column) -> Column:
    """The site's code of a category; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CATEGORIES)), x).cast("int"), F.lit(0))


def iso_instant(ts: Column) -> Column:
    """UTC with as many fraction digits as needed: none, three or six."""
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros == "000000", "").when(F.substring(micros, 4, 3) == "000", F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def iso_date(d: Column) -> Column:
    return d.cast("string")


def parse_instant(x: Column) -> Column:
    return F.to_timestamp(x)


def from_epoch_millis(x: Column) -> Column:
    return F.timestamp_millis(x)


def horizon(as_of: Column) -> Column:
    """Six calendar months back; a month's end is clamped (31 August -> 28 or 29 February)."""
    return as_of - F.make_interval(months=F.lit(HORIZON_MONTHS))


def default_range(as_of: Column) -> tuple[Column, Column]:
    """The last day up to ``as_of``, where no range is asked for."""
    return as_of - F.make_dt_interval(secs=F.lit(DEFAULT_RANGE_SECONDS)), as_of


def expires_at(issued: Column, ttl_ms: int) -> Column:
    return issued + F.make_dt_interval(secs=F.lit(ttl_ms / 1000))


def token_id() -> Column:
    """A random id; differs from run to run."""
    return F.uuid()


def to_json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
