from datetime import date

import pytest

from joblode.operators import aggregates as A
from joblode.operators.criteria import like_anywhere, search_jobs_by_criteria
from joblode.plans.tools import TOOLS
from joblode.schemas import JOBS_SCHEMA


@pytest.fixture(scope="module")
def jobs(spark):
    def row(id, role, years, skills, at, company="Acme", place="Tel Aviv"):
        return dict.fromkeys(JOBS_SCHEMA.names) | {
            "id": id, "title": f"t{id}", "role": role, "yearsexperience": years, "company": company,
            "skills_must": skills, "location": place, "seniority": "Mid"} | {"scraped_at": at}
    from datetime import datetime as dt
    rows = [row("1", "Backend", 3, ["x", "x"], dt(2024, 3, 1, 5)),
            row("2", "Backend", None, [], dt(2024, 3, 2)),
            row("3", "Data Scientist", 5, ["y", None, "x"], None, "Big_Co", "Haifa"),
            row("4", "backend", 0, None, dt(2024, 3, 1, 23, 59, 59), "BigXCo"),
            row("5", None, 9, ["y"], dt(2024, 2, 1))]
    return spark.createDataFrame([tuple(r[c] for c in JOBS_SCHEMA.names) for r in rows], JOBS_SCHEMA)


def result(df):
    return df.first()["result"]


def test_seven_tools():
    assert list(TOOLS) == ["semantic_search_jobs", "get_job_details", "get_job_aggregate",
                           "get_column_distribution", "search_jobs_by_criteria", "top_skills",
                           "top_skills_all"]


def test_aggregates(jobs):
    assert result(A.get_job_aggregate(jobs, "AVG", "yearsexperience", "backend plumber")) == 1.5
    assert result(A.get_job_aggregate(jobs, "count", "YearsExperience")) == 4
    assert result(A.get_job_aggregate(jobs, "max", "scraped_at")).day == 2
    assert result(A.get_job_aggregate(jobs, "avg", "yearsexperience", "nobody")) is None
    assert result(A.get_job_aggregate(jobs, "count", "id", "nobody")) == 0


@pytest.mark.parametrize("call", [
    lambda j: A.get_job_aggregate(j, "AVG", "posted_at"), lambda j: A.get_job_aggregate(j, "SUM", "id"),
    lambda j: A.get_job_aggregate(j, "MIN", "url"), lambda j: A.get_job_aggregate(j, "MIN", "id", "  "),
    lambda j: A.get_column_distribution(j, "url"), lambda j: A.get_column_distribution(j, "role", -1),
    lambda j: A.top_skills(j, "x", -1)])
def test_bad_arguments(jobs, call):
    with pytest.raises(ValueError):
        call(jobs)


def test_distribution(jobs, plan):
    df = A.get_column_distribution(jobs, "role")
    assert [tuple(r) for r in df.collect()] == [("Backend", 2), ("Data Scientist", 1), ("backend", 1)]
    assert "TakeOrderedAndProject" in plan(df) and "partial_count" in plan(df)
    assert A.get_column_distribution(jobs, "role", 0).count() == 0


def test_skills(jobs):
    assert [tuple(r) for r in A.top_skills(jobs, "BACKEND").collect()] == [("x", 2)]
    assert [tuple(r) for r in A.top_skills_all(jobs).collect()] == [("x", 3), ("y", 2), (None, 1)]


def test_skill_share(jobs):
    rows = {(r["role"], r["skill"]): (r["jobs_with"], r["jobs_of_role"]) for r in
            A.skill_share(jobs).collect()}
    assert rows == {("Backend", "x"): (1, 2), ("Data Scientist", "x"): (1, 1),
                    ("Data Scientist", "y"): (1, 1), ("Data Scientist", None): (1, 1)}


def ids(df):
    return [r["id"] for r in df.collect()]


def test_criteria(jobs, plan):
    assert ids(search_jobs_by_criteria(jobs)) == ["3", "2", "4", "1", "5"]
    assert ids(search_jobs_by_criteria(jobs, role="backend", max_experience=0)) == ["4"]
    assert ids(search_jobs_by_criteria(jobs, company="big_co")) == ["3", "4"]
    assert ids(search_jobs_by_criteria(jobs, company=r"big\_co")) == ["3"]
    assert ids(search_jobs_by_criteria(jobs, company=r"B\ig", location="")) == ["3", "4"]
    assert ids(search_jobs_by_criteria(jobs, company="AcmeXYZCorp999", max_experience=47)) == []
    assert "TakeOrderedAndProject" in plan(search_jobs_by_criteria(jobs))


def test_pattern_is_case_blind(spark):
    df = spark.createDataFrame([("Tel AVIV",)], "c string")
    assert df.filter(like_anywhere("c", "aviv")).count() == 1


def test_details(jobs, spark):
    rows = TOOLS["get_job_details"](jobs, ["3", "3", "nope"])
    assert ids(rows) == ["3"] and rows.columns == JOBS_SCHEMA.names
    assert TOOLS["get_job_details"](jobs, []).count() == 0
    wanted = spark.createDataFrame([("1",), ("1",), ("9",)], "job string")
    assert ids(TOOLS["get_job_details"](jobs, wanted)) == ["1"]


def test_day_count(jobs):
    assert A.count_jobs_on(jobs, date(2024, 3, 1)).first()["n"] == 2


def test_years_bound_reaches_the_scan(spark, jobs, plan, tmp_path):
    jobs.write.parquet(str(tmp_path / "j"))
    stored = spark.read.parquet(str(tmp_path / "j"))
    text = plan(search_jobs_by_criteria(stored, max_experience=3))
    assert "LessThanOrEqual(yearsexperience,3)" in text and "description" not in text
