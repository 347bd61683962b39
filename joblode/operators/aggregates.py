"""Counts, averages, distributions and skill statistics over postings.

Each is one partial/final hash aggregation; a popular value is reduced to one
row per task before the shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.operators.criteria import any_word, checked_limit, on_day, one_of

AGGREGATES = {"COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
AGGREGATE_COLUMNS = ("yearsexperience", "posted_at", "scraped_at", "id")
DISTRIBUTION_COLUMNS = ("role", "seniority", "location", "company", "yearsexperience")


def get_job_aggregate(jobs: DataFrame, operation: str, column: str,
                      role_filter: str | None = None) -> DataFrame:
    """One row ``result``; ``role_filter`` keeps roles that hold any of its words."""
    name = one_of(operation.upper(), tuple(AGGREGATES), "operation")
    column = one_of(column.lower(), AGGREGATE_COLUMNS, "column")
    if name == "AVG" and column != "yearsexperience":
        raise ValueError(f"AVG of {column} has no meaning")
    if role_filter:
        jobs = jobs.filter(any_word("role", role_filter))
    return jobs.agg(AGGREGATES[name](column).alias("result"))


def get_column_distribution(jobs: DataFrame, column: str, limit: int = 15) -> DataFrame:
    """``item, count`` of the most frequent values; ties by value."""
    column = one_of(column.lower(), DISTRIBUTION_COLUMNS, "column")
    counts = (jobs.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("item"))
              .agg(F.count(F.lit(1)).alias("count")))
    return counts.orderBy(F.desc("count"), "item").limit(checked_limit(limit))


def _skill_counts(jobs: DataFrame, limit: int) -> DataFrame:
    counts = (jobs.select(F.explode("skills_must").alias("skill")).groupBy("skill")
              .agg(F.count(F.lit(1)).alias("cnt")))
    return counts.orderBy(F.desc("cnt"), "skill").limit(checked_limit(limit))


def top_skills(jobs: DataFrame, role: str, limit: int = 10) -> DataFrame:
    """``skill, cnt`` for one role (case-blind); a skill counts once per mention."""
    return _skill_counts(jobs.filter(F.lower("role") == role.lower()), limit)


def top_skills_all(jobs: DataFrame, limit: int = 15) -> DataFrame:
    return _skill_counts(jobs, limit)


def skill_share(jobs: DataFrame) -> DataFrame:
    """Share of the postings of a role that require a skill, with both counts.

    Both counts are grouped aggregates; a role's total comes to its skills in a
    join, which Spark broadcasts or splits by size.
    """
    known = jobs.filter(F.col("role").isNotNull())
    totals = known.groupBy("role").agg(F.count(F.lit(1)).alias("jobs_of_role"))
    counts = (known.select("role", F.explode(F.array_distinct("skills_must")).alias("skill"))
              .groupBy("role", "skill").agg(F.count(F.lit(1)).alias("jobs_with")))
    return counts.join(totals, "role").select(
        "role", "skill", "jobs_with", "jobs_of_role",
        (F.col("jobs_with").cast("double") / F.col("jobs_of_role")).alias("share"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_jobs_on(jobs: DataFrame, day: date) -> DataFrame:
    """Postings loaded on a day; a table laid out by day is read for that day only."""
    if "scraped_on" in jobs.columns:
        jobs = jobs.filter(F.col("scraped_on") == F.lit(day))
    return count_rows(jobs.filter(on_day("scraped_at", day)))
