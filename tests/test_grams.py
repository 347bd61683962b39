import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from joblode.operators.criteria import any_word, like_anywhere, search_jobs_by_criteria
from joblode.sources import grams as G
from joblode.sources import tables as B

NAMES = ["Acme %1", "ACME 100%", "Bólt ΣΑΣ", "İstanbul Lab", "x_y_z", "a\\b\\c", "ab", "", None, "日本語会社", "tel aviv", "Tel  Aviv"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """One file a day; the last day's is not indexed."""
    path = str(tmp_path_factory.mktemp("grams") / "the jobs")
    rng = random.Random(5)
    for day in range(1, 7):
        few = rng.sample(NAMES, 3)
        rows = [(f"{day}-{n}", rng.choice(few), rng.choice(few), f"role {day}") for n in range(12)]
        df = spark.createDataFrame(rows, "id string, company string, location string, role string").coalesce(1)
        B.insert_jobs(spark, path, df, as_of=datetime(2024, 3, day))
        if day == 3 or day == 5:
            assert G.refresh_grams(spark, path, B.read_jobs(spark, path)) == (3 if day == 3 else 2)
    return path


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("text", ["acme", "ACME %", "e 100\\%", "100%%", "σας", "istanbul", "İst", "x\\_y", "x_y_z", "b\\\\c",
                                  "\\acme", "ab", "%", "本語会", "el%viv", "acme\\", "nobody at all", " "])
def test_same_rows_as_the_whole_scan(spark, table, text):
    jobs = B.read_jobs(spark, table)
    some = G.read_jobs_like(spark, table, jobs, company=text)
    assert some.columns == jobs.columns
    assert ids(some.filter(like_anywhere("company", text))) == ids(jobs.filter(like_anywhere("company", text)))


def test_columns_and_choices(spark, table):
    jobs = B.read_jobs(spark, table)
    for company, location in (("acme", "tel"), ("bólt", "acme"), ("x_y", None), (None, "aviv")):
        some = G.read_jobs_like(spark, table, jobs, company=company, location=location)
        asked = dict(company=company, location=location, limit=99)
        assert ids(search_jobs_by_criteria(some, **asked)) == ids(search_jobs_by_criteria(jobs, **asked))
    words = "lab bólt %1"
    some = G.read_jobs_like(spark, table, jobs, company=words.split())
    assert ids(some.filter(any_word("company", words))) == ids(jobs.filter(any_word("company", words)))
    with pytest.raises(ValueError, match="url"):
        G.read_jobs_like(spark, table, jobs, url="http")


def test_reads_only_files_that_may_match(spark, table):
    jobs = B.read_jobs(spark, table)
    days = lambda df: sorted(Path(f).parent.name[-1] for f in df.inputFiles())
    assert days(jobs) == list("123456")
    assert days(G.read_jobs_like(spark, table, jobs, role="role 2")) == ["2", "6"]  # 6 is not indexed
    assert days(G.read_jobs_like(spark, table, jobs, role="E 2", company="nobody")) == ["6"]
    assert days(G.read_jobs_like(spark, table, jobs, role=["role 2", "role 4"])) == ["2", "4", "6"]
    assert days(G.read_jobs_like(spark, table, jobs, role=["role 2", "2"])) == list("123456")
    assert days(G.read_jobs_like(spark, table, jobs, role="")) == list("123456")


def test_a_stopped_refresh_and_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "jobs")
    empty = B.read_jobs(spark, path)
    assert G.refresh_grams(spark, path, empty) == 0
    assert G.read_jobs_like(spark, path, empty, company="acme").count() == 0
    rows = spark.createDataFrame([("a", "acme"), ("b", None)], "id string, company string")
    B.insert_jobs(spark, path, rows, as_of=datetime(2024, 3, 1))
    jobs = B.read_jobs(spark, path)
    assert G.refresh_grams(spark, path, jobs) == len(jobs.inputFiles())
    assert G.read_jobs_like(spark, path, jobs, company="zzz").count() == 0
    for mark in Path(f"{path}-grams").glob("*/files/_SUCCESS"):
        mark.unlink()  # as if the list of files had not been written
    assert G.read_jobs_like(spark, path, jobs, company="zzz").count() == 2
    assert G.refresh_grams(spark, path, jobs) == len(jobs.inputFiles())
    assert jobs.filter(F.col("company") == "acme").count() == 1


def test_trigrams_of_patterns():
    assert G.literal_grams("Abcd") == {"abc", "bcd"}
    assert G.literal_grams("ab%cde_f") == {"cde"}
    assert G.literal_grams("a\\%b") == {"a%b"}
    assert G.literal_grams("ab") == G.literal_grams("") == set()
