"""Column expressions over single texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblode import constants as K


def strip(text: Column) -> Column:
    """Cut white space of any kind from both ends (``trim`` alone cuts blanks)."""
    return F.btrim(text, F.lit(K.SPACES))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A name bound by a one-element array; needed where ``use`` refers to it within
    the function of an array operation, which would repeat it per item.
    """
    return F.get(F.transform(F.array(value), use), 0)


def nonempty(text: Column) -> Column:
    """The text, or NULL where it is empty."""
    return F.nullif(text, F.lit(""))


def job_id(url: Column) -> Column:
    """First ``-`` followed by 7+ digits, else the first run of 10+ digits."""
    return F.coalesce(nonempty(F.regexp_extract(url, r"-(\d{7,})", 1)),
                      nonempty(F.regexp_extract(url, r"(\d{10,})", 1)))


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def infer_role(title: Column) -> Column:
    """Role by the words of a title; the first matching group wins."""
    def judge(low: Column) -> Column:
        rule = F
        for role, words in K.ROLE_WORDS:
            rule = rule.when(contains_any(low, words), F.lit(role))
        product = (low.contains("product") & low.contains("manager")) | contains_any(
            low, K.PRODUCT_WORDS)
        return rule.when(product, F.lit(K.PRODUCT_ROLE)).otherwise(F.lit(K.DEFAULT_ROLE))

    return let(F.lower(F.coalesce(title, F.lit(""))), judge)


def seniority_by_years(seniority: Column, years: Column) -> Column:
    """Years of experience decide, except where a leadership role is named."""
    return (F.when(years.isNull() | F.coalesce(seniority.isin(*K.LEADERSHIP), F.lit(False)),
                   seniority)
            .when(years <= 3, F.lit("Junior"))
            .when(years <= 5, F.lit("Mid"))
            .otherwise(F.lit("Senior")))


def duration(seconds: Column) -> Column:
    """``2m 5s`` from a minute on, else seconds with one decimal, as ``12.3s``.

    The decimal is rounded from the exact binary value, ties to even: the
    fraction is scaled by a power of two, which loses nothing, and divided as an
    integer.
    """
    one = 1 << 57
    whole = F.floor(seconds).cast("bigint")
    tenfold = ((seconds - whole) * F.lit(float(one))).cast("bigint") * F.lit(10)
    down = F.shiftright(tenfold, 57)
    rest = tenfold - F.shiftleft(down, 57)
    tenths = whole * 10 + down
    up = (rest > F.lit(one // 2)) | ((rest == F.lit(one // 2)) & (tenths % 2 == 1))
    tenths = tenths + F.when(up, F.lit(1)).otherwise(F.lit(0))
    short = F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    minutes = F.concat(F.floor(seconds / 60).cast("bigint").cast("string"), F.lit("m "),
                       F.floor(seconds % 60).cast("bigint").cast("string"), F.lit("s"))
    return F.when(seconds >= 60, minutes).otherwise(short)


def long_date(day: Column) -> Column:
    """``March 05, 2024``."""
    return F.date_format(day, "MMMM dd, yyyy")


def request_text(title: Column, description: Column, max_chars: int | None = None) -> Column:
    """The text sent to an extractor.

    The whole description goes in; pass ``max_chars`` for a model with a bound
    on its input.
    """
    body = description if max_chars is None else F.substring(description, 1, max_chars)
    return F.concat(F.lit(K.REQUEST_TITLE), title, F.lit(K.REQUEST_BODY), body,
                    F.lit(K.REQUEST_END))


def truthy_items(items: Column) -> Column:
    """A text list without its NULL and empty items."""
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def clean_texts(texts: Column) -> Column:
    """Texts ready to embed: nested lists flattened, stripped, blanks kept as one blank."""
    def clean(x: Column) -> Column:
        return F.coalesce(nonempty(strip(x)), F.lit(" "))
    return F.transform(F.flatten(texts), clean)
