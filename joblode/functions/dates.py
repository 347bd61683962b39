"""Posting dates, absolute or relative, in English or Hebrew."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions.text import contains_any, nonempty, strip

# Beyond this no calendar date is left to subtract from.
_MAX_DAYS = 3_650_000


def moment(as_of: datetime | str | Column) -> Column:
    """``as_of`` as a zone-free timestamp column."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def parse_posted_date(text: Column, as_of: datetime | str | Column) -> Column:
    """DATE of a posting.

    An ISO date wins if it exists in the calendar. Otherwise the first number
    (1 if none) counts back from ``as_of`` in the first unit whose word the text
    holds as a substring. Texts without a unit, and dates before year 1, give NULL.
    """
    now = moment(as_of)
    text = strip(text)
    low = F.lower(text)
    iso = F.try_to_date(nonempty(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)), "yyyy-MM-dd")

    digits = nonempty(F.regexp_extract(text, r"(\d+)", 1))
    number = F.when(digits.isNull(), F.lit(1)).otherwise(digits.try_cast("int"))
    words = dict(K.AGE_WORDS)

    def days_back(unit: str) -> Column:
        days = K.AGE_DAYS[unit]
        fits = F.when(number <= _MAX_DAYS // days, number)
        return F.date_sub(F.to_date(now), fits * days)

    hours = F.when(number <= _MAX_DAYS * 24, number)
    relative = (
        F.when(contains_any(low, words["hour"]),
               F.to_date(now - F.make_dt_interval(F.lit(0), hours)))
        .when(contains_any(low, words["day"]), days_back("day"))
        .when(contains_any(low, words["week"]), days_back("week"))
        .when(contains_any(low, words["month"]), days_back("month"))
        .when(contains_any(low, words["now"]), F.to_date(now)))
    calendar = lambda day: F.when(day >= F.lit("0001-01-01").cast("date"), day)
    return F.coalesce(calendar(iso), calendar(relative))
