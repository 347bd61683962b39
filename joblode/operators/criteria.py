"""Predicates over postings and the criteria search."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_COLUMNS = ("id", "title", "company", "role", "location", "url")


def like_pattern(text: str) -> str:
    """The lower-cased LIKE pattern of a substring; ``%`` and ``_`` in ``text`` act as wildcards.

    A backslash before an ordinary character stands for that character.
    """
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in r"%_\\" else m[1], f"%{text}%", flags=re.S).lower()


def like_anywhere(column: str, text: str) -> Column:
    """Case-blind substring, see :func:`like_pattern`."""
    return F.lower(F.col(column)).like(like_pattern(text))


def any_word(column: str, words: str) -> Column:
    """Any of the blank-separated words occurs in the column."""
    parts = words.split()
    if not parts:
        raise ValueError("the filter holds no word")
    return reduce(or_, [like_anywhere(column, w) for w in parts])


def on_day(column: str, day: date) -> Column:
    """Timestamps of one calendar day, as a range that a scan can prune by."""
    first = F.lit(day.isoformat()).cast("timestamp_ntz")
    after = F.lit((day + timedelta(days=1)).isoformat()).cast("timestamp_ntz")
    return (F.col(column) >= first) & (F.col(column) < after)


def checked_limit(limit: int) -> int:
    if limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    return limit


def one_of(name: str, allowed: Sequence[str], what: str) -> str:
    if name not in allowed:
        raise ValueError(f"{what} {name!r} not allowed; use one of {', '.join(allowed)}")
    return name


def criteria(role: str | None = None, location: str | None = None, company: str | None = None,
             max_experience: int | None = None) -> Column | None:
    """All criteria that are given, or None; an empty text counts as not given."""
    parts = [like_anywhere(column, text) for column, text in
             (("role", role), ("location", location), ("company", company)) if text]
    if max_experience is not None:
        parts.append(F.col("yearsexperience") <= max_experience)
    return reduce(and_, parts) if parts else None


def search_jobs_by_criteria(jobs: DataFrame, role: str | None = None, location: str | None = None,
                            company: str | None = None, max_experience: int | None = None,
                            limit: int = 10) -> DataFrame:
    """The newest postings that meet the criteria; those without a load time come first."""
    wanted = criteria(role, location, company, max_experience)
    hits = jobs if wanted is None else jobs.filter(wanted)
    newest = (F.col("scraped_at").desc_nulls_first(), F.col("id"))
    return hits.orderBy(*newest).limit(checked_limit(limit)).select(*HIT_COLUMNS)
