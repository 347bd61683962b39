"""Questions over postings: search by criteria, aggregates, distributions, skills."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from joblode.operators import aggregates as A
from joblode.operators.criteria import HIT_COLUMNS, any_word, like_anywhere, search_jobs_by_criteria
from joblode.operators.keys import rows_with_ids
from joblode.plans.tools import TOOLS, get_job_details
from joblode.schemas import STAGED_COLUMNS
from joblode.session import scratch
from joblode.sources import tables as B
from joblode.sources.grams import read_jobs_like, refresh_grams
from workload.registry import case
from workload.views import JOBS, joined, jobs, sql_joined, table

LISTS = ("skills_must", "skills_nice", "past_experience")


def _top(where: str, limit: int) -> str:
    return f"""WITH {JOBS} SELECT skill, count(*) AS cnt
      FROM (SELECT unnest(skills_must) AS skill FROM jobs {where})
      GROUP BY skill ORDER BY cnt DESC, skill LIMIT {limit}"""


@case("top_skills", _top("WHERE lower(role) = lower('backend')", 10))
def _(spark, sf):
    return TOOLS["top_skills"](jobs(spark, sf), "backend")


@case("top_skills_all", _top("", 15))
def _(spark, sf):
    return A.top_skills_all(jobs(spark, sf))


for _name, _op, _column in (("count", "count", "id"), ("avg", "AVG", "yearsexperience"),
                            ("min", "Min", "posted_at"), ("max", "max", "scraped_at")):
    case(f"job_aggregate_{_name}",
         f"WITH {JOBS} SELECT {_op}({_column}) AS result FROM jobs")(
        lambda spark, sf, op=_op, column=_column: A.get_job_aggregate(jobs(spark, sf), op, column))


@case("aggregate_role_words", f"""WITH {JOBS} SELECT avg(yearsexperience) AS result FROM jobs
  WHERE lower(role) LIKE '%data%' OR lower(role) LIKE '%end%'""")
def _(spark, sf):
    return A.get_job_aggregate(jobs(spark, sf), "AVG", "yearsexperience", " Data  END ")


@case("aggregate_no_match", f"""WITH {JOBS} SELECT max(yearsexperience) AS result FROM jobs
  WHERE lower(role) LIKE '%plumber%'""")
def _(spark, sf):
    return A.get_job_aggregate(jobs(spark, sf), "MAX", "yearsexperience", "plumber")


for _name, _column in (("role", "role"), ("seniority", "seniority"), ("location", "location"),
                       ("company", "company"), ("years", "yearsexperience")):
    case(f"distribution_{_name}", f"""WITH {JOBS} SELECT {_column} AS item, count(*) AS count
      FROM jobs WHERE {_column} IS NOT NULL GROUP BY {_column}
      ORDER BY count DESC, item LIMIT 15""")(
        lambda spark, sf, column=_column: A.get_column_distribution(jobs(spark, sf), column))

_HITS = "SELECT id, title, company, role, location, url FROM jobs"
_NEWEST = "ORDER BY scraped_at DESC NULLS FIRST, id LIMIT 10"
_WANTED = f"""{_HITS} WHERE lower(role) LIKE '%end%' AND lower(location) LIKE '%e%'
  AND yearsexperience <= 7 {_NEWEST}"""


@case("criteria_search", f"WITH {JOBS} {_WANTED}")
def _(spark, sf):
    return search_jobs_by_criteria(jobs(spark, sf), role="END", location="e", max_experience=7)


@case("criteria_wildcards", f"WITH {JOBS} {_HITS} WHERE lower(company) LIKE '%s_c1%' {_NEWEST}")
def _(spark, sf):
    return search_jobs_by_criteria(jobs(spark, sf), role="", company="S_C1")


@case("criteria_none", f"WITH {JOBS} {_HITS} {_NEWEST}")
def _(spark, sf):
    return search_jobs_by_criteria(jobs(spark, sf))


@case("criteria_no_match", f"""WITH {JOBS} {_HITS} WHERE lower(company) LIKE '%acmexyzcorp999%'
  AND yearsexperience <= 47 {_NEWEST}""")
def _(spark, sf):
    return search_jobs_by_criteria(jobs(spark, sf), company="AcmeXYZCorp999", max_experience=47)


@case("criteria_pruned", f"""WITH {JOBS} {_HITS} WHERE lower(company) LIKE '%s_c1%'
  AND (lower(title) LIKE '%data%' OR lower(title) LIKE '%lead%')""")
def _(spark, sf):
    """All postings of a stored table that meet two filters, read from the files that may hold one."""
    path = scratch(spark, "jobs-table")
    B.insert_jobs(spark, path, jobs(spark, sf), as_of="2024-03-10 02:00:00")
    stored = B.read_jobs(spark, path)
    refresh_grams(spark, path, stored)
    some = read_jobs_like(spark, path, stored, company="S_C1", title=["data", "lead"])
    return some.filter(like_anywhere("company", "S_C1") & any_word("title", "data lead")).select(*HIT_COLUMNS)


@case("job_details", f"""WITH {JOBS}, hits AS ({_WANTED})
  SELECT id, title, role, seniority, company, location, url, description, yearsexperience, keyword,
    source, posted_at, scraped_at, {', '.join(map(sql_joined, LISTS))}
  FROM jobs WHERE id IN (SELECT id FROM hits)""")
def _(spark, sf):
    all_jobs = jobs(spark, sf)
    hits = search_jobs_by_criteria(all_jobs, role="end", location="e", max_experience=7)
    rows = get_job_details(all_jobs, hits.select("id"))
    return rows.select(*[c for c in rows.columns if c not in LISTS], *joined(*LISTS))


@case("jobs_by_ids", f"""WITH {JOBS}
  SELECT id, title, role, seniority, company, location, url, description, yearsexperience, keyword,
    source, posted_at, {', '.join(map(sql_joined, LISTS))}
  FROM jobs WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""")
def _(spark, sf):
    ids = table(spark, sf, "labels").select(F.col("doc_id").cast("string"))
    rows = rows_with_ids(jobs(spark, sf), ids).select(*STAGED_COLUMNS)
    return rows.select(*[c for c in rows.columns if c not in LISTS], *joined(*LISTS))


@case("skill_share", f"""WITH {JOBS}, of_role AS (
    SELECT role, count(*) AS jobs_of_role FROM jobs WHERE role IS NOT NULL GROUP BY role),
  of_skill AS (SELECT role, skill, count(DISTINCT id) AS jobs_with
    FROM (SELECT id, role, unnest(skills_must) AS skill FROM jobs WHERE role IS NOT NULL)
    GROUP BY role, skill)
  SELECT role, skill, jobs_with, jobs_of_role,
         round(CAST(jobs_with AS DOUBLE) / jobs_of_role, 6) AS share
  FROM of_skill JOIN of_role USING (role)""")
def _(spark, sf):
    return A.skill_share(jobs(spark, sf)).withColumn("share", F.round("share", 6))


@case("count_jobs", f"WITH {JOBS} SELECT count(*) AS n FROM jobs")
def _(spark, sf):
    return A.count_rows(jobs(spark, sf))


@case("count_jobs_on_day",
      f"WITH {JOBS} SELECT count(*) AS n FROM jobs WHERE CAST(scraped_at AS DATE) = DATE '2024-03-01'")
def _(spark, sf):
    return A.count_jobs_on(jobs(spark, sf), date(2024, 3, 1))
