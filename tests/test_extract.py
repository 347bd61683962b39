"""Replies are checked against a restatement of the rules in plain Python."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from joblode import constants as K
from joblode.operators import extract as E

COLUMNS = ("role", "seniority", "description", "yearsexperience", "skills_must", "skills_nice",
           "past_experience")
EMPTY = ("Other", "Not specified", None, None, [], [], [])


def check(spark, raws, title="Backend Developer", description="d"):
    df = spark.createDataFrame([(i, r, title, description) for i, r in enumerate(raws)],
                               "i int, raw string, title string, raw_description string")
    return [tuple(r[c] for c in COLUMNS) for r in E.check_replies(df).orderBy("i").collect()]


@pytest.mark.parametrize("raw, changed", [
    ('```json\n{"role":"QA / Automation","experience":"3"}\n```',
     {"role": "QA / Automation", "yearsexperience": 3, "seniority": "Junior"}),
    ('{"role":null}', {"role": "Backend"}), ("{}", {}),
    ('{"experience":null,"yearsexperience":5}', {}),
    ('{"yearsexperience":5}', {"yearsexperience": 5, "seniority": "Mid"}),
    ('{"experience":3.7}', {"yearsexperience": 3, "seniority": "Junior"}),
    ('{"experience":-3.7}', {"yearsexperience": -3, "seniority": "Junior"}),
    ('{"experience":"3.7"}', {}), ('{"experience":"5+"}', {}),
    ('{"experience":" 1_0 "}', {"yearsexperience": 10, "seniority": "Senior"}),
    ('{"experience":true}', {"yearsexperience": 1, "seniority": "Junior"}),
    ('{"skills_must":["a",null,"",0,"0",false,[],{}]}', {"skills_must": ["a", "0"]}),
    ('{"skills_must":["a","a"," b "]}', {"skills_must": ["a", "a", " b "]}),
    ('{"skills_must":"python"}', {}), ('{"role":"backend"}', {"role": "Backend"}),
    ('{"role":"BI","role":"Mobile"}', {"role": "Mobile"}),
    ('say {"role":"BI"} done', {"role": "BI"}),
    ('{"description":"  a \\n"}', {"description": "a"}), ('{"description":""}', {}),
    ('{"seniority":"lead"}', {}), ('{"seniority":"Lead","experience":9}',
                                   {"seniority": "Lead", "yearsexperience": 9})])
def test_reply(spark, raw, changed):
    want = dict(zip(COLUMNS, EMPTY)) | changed
    assert check(spark, [raw]) == [tuple(want[c] for c in COLUMNS)]


@pytest.mark.parametrize("raw", ["not json", '{"role":["x"]}', '{"seniority":{}}', "[1]", "5", "",
                                 None, '{"role":"BI"} x}', "{'role':'BI'}", '{"a":1},{"b":2}'])
def test_unusable_reply(spark, raw):
    assert check(spark, [raw]) == [EMPTY]


@pytest.mark.parametrize("description", [None, "", "N/A"])
def test_no_description(spark, description):
    assert check(spark, ['{"role":"BI"}'], description=description) == [EMPTY]


def py_role(title):
    low = title.lower()
    for role, words in K.ROLE_WORDS:
        if any(w in low for w in words):
            return role
    both = "product" in low and "manager" in low
    return "Product Manager" if both or any(w in low for w in K.PRODUCT_WORDS) else "Other"


def py_check(data, title):
    years = data["experience"] if "experience" in data else data.get("yearsexperience")
    if isinstance(years, str):
        years = int(years) if years.strip().lstrip("+-").isdigit() else None
    elif isinstance(years, (bool, int, float)):
        years = int(years)
    else:
        years = None
    role = data.get("role", "Other")
    level = data.get("seniority", "Not specified")
    level = level if level in K.VALID_SENIORITY else "Not specified"
    if years is not None and level not in K.LEADERSHIP:
        level = "Junior" if years <= 3 else "Mid" if years <= 5 else "Senior"

    def listed(key):
        value = data.get(key, [])
        return [str(v) for v in value if v] if isinstance(value, list) else []

    about = data.get("description")
    return (role if role in K.VALID_ROLES else py_role(title), level,
            str(about).strip() if about else None, years, *map(listed, COLUMNS[4:]))


scalar = st.one_of(st.none(), st.booleans(), st.integers(-50, 50), st.sampled_from(
    ["", "0", " 7 ", "x", "Backend", "Lead", "Mobile", "Intern", "+4", "-2", "3.5", "c++"]))
reply = st.fixed_dictionaries({}, optional={
    "role": st.one_of(scalar, st.sampled_from(K.VALID_ROLES)),
    "seniority": st.one_of(scalar, st.sampled_from(K.VALID_SENIORITY)),
    "experience": st.one_of(scalar, st.floats(-9, 9).map(lambda x: round(x, 2))),
    "yearsexperience": scalar, "description": scalar,
    "skills_must": st.one_of(scalar, st.lists(scalar, max_size=5)),
    "skills_nice": st.lists(scalar, max_size=3), "past_experience": st.lists(scalar, max_size=2)})


@settings(max_examples=12, deadline=None)
@given(st.lists(reply, min_size=25, max_size=25), st.sampled_from(
    ["Senior QA", "QA Lead", "iOS dev", "Head of Product", "Studios", "Clerk"]))
def test_any_reply(spark, replies, title):
    got = check(spark, [json.dumps(r) for r in replies], title)
    assert got == [py_check(r, title) for r in replies]


def test_model_is_not_asked_without_text_and_may_fail(spark):
    def model(title, description):
        if title == "bad":
            raise RuntimeError
        return json.dumps({"role": "BI", "description": description})

    stubs = spark.createDataFrame(
        [("1", "t", "some text"), ("2", "bad", "text"), ("3", "t", "N/A"), ("4", "t", None)],
        "id string, title string, raw_description string")
    rows = {r["id"]: r for r in E.extract(stubs, model).collect()}
    assert rows["1"]["role"] == "BI" and rows["1"]["description"] == "some text"
    assert all(tuple(rows[i][c] for c in COLUMNS) == EMPTY for i in "234")


def test_rules(spark):
    text = ("We want 5+ years of experience in FinTech. Python, SQL and React Native needed; 2-4 years of Go.\n"
            "Kafka is an advantage. Background in embedded systems")
    stubs = spark.createDataFrame([("Senior Data Engineer", text), ("QA Manager", "Nothing said"),
                                   ("Dev", None)], "title string, raw_description string")
    one, two, three = E.extract(stubs).collect()
    assert (one["role"], one["seniority"], one["yearsexperience"]) == ("Data Engineer", "Mid", 5)
    assert set(one["skills_must"]) == {"python", "sql", "react native", "react"}
    assert one["skills_nice"] == ["kafka"]
    assert one["past_experience"] == ["FinTech", "embedded systems"]
    assert (two["role"], two["seniority"], two["yearsexperience"]) == (
        "QA / Automation", "Manager", None)
    assert tuple(three[c] for c in COLUMNS) == EMPTY


def test_own_vocabulary(spark):
    stubs = spark.createDataFrame([("Dev", "We use Foo.Bar and go.")], "title string, raw_description string")
    assert E.extract(stubs, skills=("foo.bar", "go", "zap")).first()["skills_must"] == ["foo.bar", "go"]
    assert E.extract(stubs, skills=()).first()["skills_must"] == []


def test_second_try(spark, tmp_path):
    """A model that first answers badly is asked again; one that never answers well is counted."""
    def load():
        seen = {}

        def model(title, description):
            seen[title] = seen.get(title, 0) + 1
            if title == "never" or seen[title] < 3:
                return "not json"
            return json.dumps({"role": "BI"})
        return model

    stubs = spark.createDataFrame([("1", "late", "text"), ("2", "never", "text"), ("3", "x", None)],
                                  "id string, title string, raw_description string")
    asked = E.model_replies(stubs, load=load)
    rows = {r["id"]: r for r in asked.withColumn("bad", E.unanswered(asked)).collect()}
    assert [rows[i]["bad"] for i in "123"] == [False, True, False] and rows["2"]["raw"] == "not json"
    assert {r["id"]: r["role"] for r in E.extract(stubs, load=load).collect()} == {"1": "BI", "2": "Other", "3": "Other"}


def test_batches(spark):
    stubs = spark.createDataFrame([(str(i), f"t{i}", "text") for i in range(5)], "id string, title string, raw_description string")
    model = lambda titles, texts: [json.dumps({"description": f"{t} of {len(titles) > 0}"}) for t in titles]
    rows = E.extract(stubs, model, batched=True).collect()
    assert {r["description"] for r in rows} == {f"t{i} of True" for i in range(5)}
    with pytest.raises(ValueError):
        E.model_replies(stubs)


def test_only_texts_go_to_python(spark, plan):
    stubs = spark.createDataFrame([("1", "t", "d")], "id string, title string, raw_description string")
    text = plan(E.model_replies(stubs, lambda t, d: "{}"))
    assert "ArrowEvalPython" in text and "MapInPandas" not in text
