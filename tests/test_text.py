import json
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions import text as X
from joblode.functions.dates import parse_posted_date
from joblode.functions.html import Css, attribute, inner, opening_tag, short_inner, visible_text

AS_OF = "2024-03-10 02:00:00"


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("text, want", [
    ("2024-01-05T10:00:00", date(2024, 1, 5)), ("2024-13-45", None),
    ("5 hours ago", date(2024, 3, 9)), ("1 hour ago", date(2024, 3, 10)),
    ("לפני 3 ימים", date(2024, 3, 7)), ("לפני שבוע", date(2024, 3, 3)),
    ("לפני שבועיים", date(2024, 3, 3)), ("לפני חודשיים", date(2024, 2, 9)), ("יומיים", None),
    ("2 months ago", date(2024, 1, 10)), ("today", date(2024, 3, 9)),
    ("yesterday", date(2024, 3, 9)), ("just now", date(2024, 3, 10)), ("10 minutes ago", None),
    ("2 years ago", None), ("", None), (None, None), ("2024-13-45, 3 weeks", date(2024, 3, 10) - timedelta(weeks=2024)),
    ("99999999999999999999 days ago", None), ("900000 days ago", None)])
def test_posted_date(spark, text, want):
    assert column(spark, [text], lambda c: parse_posted_date(c, AS_OF)) == [want]


def test_job_id(spark):
    urls = ["https://x/jobs/view/data-engineer-1234567890?ref=a", "https://x/jobs/view/dev-1234567",
            "https://x/jobs/view/1234567890", "https://x/jobs/view/123456789", ""]
    assert column(spark, urls, X.job_id) == ["1234567890", "1234567", "1234567890", None, None]
    assert column(spark, ["a?b?c", "a"], X.without_query) == ["a", "a"]


ROLE_CASES = {
    "Front-End Engineer": "Frontend", "Senior Backend Developer": "Backend",
    "NLP Data Scientist": "AI / ML", "BI Developer": "Data Analyst", "Studios Manager": "Mobile",
    "Senior QA": "Other", "QA Lead": "QA / Automation", "Engineering Manager": "Team Lead",
    "Manager of Product": "Product Manager", "Head of Product": "Product Manager",
    "Product Software Engineer Manager": "Software Development", "Accountant": "Other"}


def test_role_of_title(spark):
    assert column(spark, list(ROLE_CASES), X.infer_role) == list(ROLE_CASES.values())
    assert column(spark, [None], X.infer_role) == ["Other"]


def test_seniority(spark):
    df = spark.createDataFrame([("Intern", 6), ("Senior", 3), ("Senior", 5), ("Lead", 1),
                                ("Not specified", None), (None, 2)], "s string, y int")
    got = df.select(X.seniority_by_years(F.col("s"), F.col("y")).alias("x")).collect()
    assert [r["x"] for r in got] == ["Senior", "Junior", "Mid", "Lead", "Not specified", "Junior"]


def test_duration_rounds_like_the_binary_value(spark):
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 12.35, 59.95, 59.96, 3.0]
    assert column(spark, values, X.duration, "double") == [f"{v:.1f}s" for v in values]
    assert column(spark, [60.0, 125.9, 3600.0], X.duration, "double") == ["1m 0s", "2m 5s", "60m 0s"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 59.999), min_size=50, max_size=50))
def test_duration_any(spark, values):
    assert column(spark, values, X.duration, "double") == [f"{v:.1f}s" for v in values]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \t\n\x0b\x1c\x85\xa0 　"), max_size=8),
                min_size=20, max_size=20))
def test_strip_any(spark, values):
    assert column(spark, values, X.strip) == [v.strip() for v in values]


def test_clean_texts(spark):
    df = spark.createDataFrame([([[" a ", ""], ["\xa0"]],)], "t array<array<string>>")
    assert df.select(X.clean_texts(F.col("t")).alias("x")).first()["x"] == ["a", " ", " "]


def test_request_holds_the_whole_text(spark):
    long = "x" * 9000
    df = spark.createDataFrame([("T", long)], "t string, d string")
    whole = df.select(X.request_text(F.col("t"), F.col("d")).alias("x")).first()["x"]
    assert whole == f"Job Title: T\n\nJob Description:\n{long}\n\nJSON:"
    cut = df.select(X.request_text(F.col("t"), F.col("d"), 5000).alias("x")).first()["x"]
    assert len(cut) == len(whole) - 4000


def test_html(spark):
    page = ('<div>x</div><ul class="a jobs"><li class="k"><div><h3 class="t u">A &amp; <b>b</b></h3>'
            '<div>in</div>tail</div></li></ul><time datetime=\'2024-01-02\' class="p">3 days</time>'
            '<em class="note">4 <b>weeks</b></em><ul class="jobs2">no</ul>')
    df = spark.createDataFrame([(page,)], "h string")
    h = F.col("h")
    row = df.select(
        inner(h, Css("ul", "jobs")).alias("list"), inner(h, Css("ul", "job")).alias("none"),
        inner(inner(h, Css("ul", "jobs")), Css("div")).alias("nested"),
        visible_text(inner(h, Css("h3", "t"))).alias("title"),
        attribute(opening_tag(h, Css("time", attr="datetime")), "datetime").alias("stamp"),
        visible_text(short_inner(h, Css("span", "note"), Css("[a-z][a-z0-9]*", "note"))).alias("note"),
        short_inner(h, Css("span", "note")).alias("span")).first()
    assert row["list"].startswith('<li class="k">') and row["list"].endswith("</li>")
    assert row["none"] is None and row["span"] is None
    assert row["nested"] == '<h3 class="t u">A &amp; <b>b</b></h3><div>in</div>tail'
    assert (row["title"], row["stamp"], row["note"]) == ("A & b", "2024-01-02", "4 weeks")


def test_visible_text(spark):
    pages = ["<p>a  b</p><p> c<br/>d </p>", "<script>var x='<p>'</script>k<!-- n -->l", "div <b>x", "",
             "<div><div>deep</div> &lt;i&gt; &amp;lt;</div>"]
    assert column(spark, pages, visible_text) == ["a b\nc\nd", "kl", "div x", "", "deep\n<i> &lt;"]


def test_element_without_an_end(spark):
    assert column(spark, ["<div>div a<p>b"], lambda c: inner(c, Css("div"))) == ["div a<p>b"]


def test_fixed_values():
    assert len(K.KEYWORDS) == len(set(K.KEYWORDS)) and len(K.VALID_ROLES) == 22
    assert len(K.VALID_SENIORITY) == 11 and json.dumps(K.FULL_TEXT)
