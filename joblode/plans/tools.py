"""The question tools, by name: functions from tables to a DataFrame.

A bad argument raises ``ValueError`` before any plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from joblode.operators.aggregates import (get_column_distribution, get_job_aggregate, skill_share,
                                          top_skills, top_skills_all)
from joblode.operators.criteria import search_jobs_by_criteria
from joblode.operators.keys import rows_with_ids
from joblode.operators.vectors import semantic_search_jobs
from joblode.schemas import JOBS_SCHEMA


def get_job_details(jobs: DataFrame, job_ids: DataFrame | Sequence[str]) -> DataFrame:
    """All columns of the postings asked for."""
    return rows_with_ids(jobs, job_ids).select(*JOBS_SCHEMA.names)


TOOLS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (
    semantic_search_jobs, get_job_details, get_job_aggregate, get_column_distribution,
    search_jobs_by_criteria, top_skills, top_skills_all)}

__all__ = ["TOOLS", "skill_share", *TOOLS]
