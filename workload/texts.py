"""Scalar expressions: dates, ids, roles, replies, texts for the vector table."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions import jobtext as J
from joblode.functions import text as X
from joblode.functions.dates import parse_posted_date
from joblode.operators import extract as E
from joblode.operators.vectors import vector_texts
from workload.registry import case
from workload.views import (AGES, JOBS, REPLIES, TITLES, joined, jobs, pick, q, replies, sql_list,
                            sql_pick, table)

AS_OF = "2024-03-10 02:00:00"
LISTS = ("skills_must", "skills_nice", "past_experience")


def sql_strip(text: str) -> str:
    return f"trim({text}, {q(K.SPACES)})"


def sql_contains_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


_UNITS = dict(K.AGE_WORDS)
_DATE = f"""CASE WHEN iso IS NOT NULL THEN iso
  WHEN {sql_contains_any('low', _UNITS['hour'])} THEN CAST(TIMESTAMP '{AS_OF}' - to_hours(n) AS DATE)
  WHEN {sql_contains_any('low', _UNITS['day'])} THEN CAST(TIMESTAMP '{AS_OF}' - to_days(n) AS DATE)
  WHEN {sql_contains_any('low', _UNITS['week'])} THEN CAST(TIMESTAMP '{AS_OF}' - to_days(7 * n) AS DATE)
  WHEN {sql_contains_any('low', _UNITS['month'])} THEN CAST(TIMESTAMP '{AS_OF}' - to_days(30 * n) AS DATE)
  WHEN {sql_contains_any('low', _UNITS['now'])} THEN CAST(TIMESTAMP '{AS_OF}' AS DATE) END"""


@case("posted_date_parse", f"""WITH ages AS (SELECT doc_id, replace({sql_pick(AGES, 'doc_id % 10')},
    '{{n}}', CAST(doc_id % 40 AS VARCHAR)) AS age FROM documents),
  parts AS (SELECT doc_id, age, lower(age) AS low,
    CAST(try_strptime(regexp_extract(age, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '%Y-%m-%d') AS DATE) AS iso,
    coalesce(TRY_CAST(nullif(regexp_extract(age, '(\\d+)', 1), '') AS INTEGER), 1) AS n FROM ages)
  SELECT doc_id, age, {_DATE} AS posted_at FROM parts""")
def _(spark, sf):
    i = F.col("doc_id")
    aged = table(spark, sf, "documents").select("doc_id", F.replace(
        pick(AGES, i % 10), F.lit("{n}"), (i % 40).cast("string")).alias("age"))
    return aged.withColumn("posted_at", parse_posted_date(F.col("age"), AS_OF))


@case("job_id_extract", """WITH urls AS (SELECT url FROM pages UNION ALL
    SELECT url || '/jobs/view/dev-' || (page_id * 77777) || '?r=' || page_id FROM pages UNION ALL
    SELECT url || '/view/' || (page_id * 9876543) FROM pages)
  SELECT url, coalesce(nullif(regexp_extract(url, '-(\\d{7,})', 1), ''),
    nullif(regexp_extract(url, '(\\d{10,})', 1), '')) AS id, split_part(url, '?', 1) AS bare
  FROM urls""")
def _(spark, sf):
    i = F.col("page_id")
    made = F.array("url", F.concat("url", F.lit("/jobs/view/dev-"), (i * 77777).cast("string"),
                                   F.lit("?r="), i.cast("string")),
                   F.concat("url", F.lit("/view/"), (i * 9876543).cast("string")))
    urls = table(spark, sf, "pages").select(F.explode(made).alias("url"))
    return urls.select("url", X.job_id(F.col("url")).alias("id"),
                       X.without_query(F.col("url")).alias("bare"))


def sql_role(title: str) -> str:
    low = f"lower({title})"
    rules = " ".join(f"WHEN {sql_contains_any(low, words)} THEN {q(role)}"
                     for role, words in K.ROLE_WORDS)
    return (f"CASE {rules} WHEN (contains({low}, 'product') AND contains({low}, 'manager')) OR "
            f"{sql_contains_any(low, K.PRODUCT_WORDS)} THEN {q(K.PRODUCT_ROLE)} "
            f"ELSE {q(K.DEFAULT_ROLE)} END")


@case("infer_role", f"""SELECT doc_id, {sql_role(sql_pick(TITLES, 'doc_id % 20'))} AS by_title,
  {sql_role('text')} AS by_text FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents", heavy=True).select(
        "doc_id", X.infer_role(pick(TITLES, F.col("doc_id") % 20)).alias("by_title"),
        X.infer_role(F.col("text")).alias("by_text"))


def sql_seniority(named: str, years: str) -> str:
    leaders = ", ".join(map(q, K.LEADERSHIP))
    return (f"CASE WHEN {years} IS NULL OR {named} IN ({leaders}) THEN {named} "
            f"WHEN {years} <= 3 THEN 'Junior' WHEN {years} <= 5 THEN 'Mid' ELSE 'Senior' END")


@case("seniority_rule", f"""WITH {JOBS} SELECT id, {sql_seniority(
    sql_pick(K.VALID_SENIORITY, 'CAST(id AS BIGINT) % 11'), 'yearsexperience')} AS level FROM jobs""")
def _(spark, sf):
    named = pick(K.VALID_SENIORITY, F.col("id").cast("bigint") % 11)
    return jobs(spark, sf).select(
        "id", X.seniority_by_years(named, F.col("yearsexperience")).alias("level"))


@case("duration_text", """SELECT event_id, CASE WHEN value >= 60
    THEN CAST(floor(value / 60) AS BIGINT) || 'm ' || CAST(floor(value % 60) AS BIGINT) || 's'
    ELSE printf('%.1fs', value) END AS took FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", X.duration(F.col("value")).alias("took"))


@case("long_date", "SELECT event_id, strftime(ts, '%B %d, %Y') AS day FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", X.long_date(F.col("ts")).alias("day"))


@case("request_text", f"""WITH {JOBS} SELECT id, 'Job Title: ' || title || chr(10) || chr(10)
  || 'Job Description:' || chr(10) || description || chr(10) || chr(10) || 'JSON:' AS request FROM jobs""")
def _(spark, sf):
    return jobs(spark, sf).select(
        "id", X.request_text(F.col("title"), F.col("description")).alias("request"))


@case("clean_texts", f"""WITH nested AS (SELECT doc_id, flatten([['  ' || source || chr(10), ''],
    [text || chr(160)], [lang, chr(9)]]) AS texts FROM documents),
  items AS (SELECT doc_id, generate_subscripts(texts, 1) - 1 AS pos, unnest(texts) AS t FROM nested)
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, coalesce(nullif({sql_strip('t')}, ''), ' ') AS cleaned
  FROM items""")
def _(spark, sf):
    nested = F.array(F.array(F.concat(F.lit("  "), "source", F.lit("\n")), F.lit("")),
                     F.array(F.concat("text", F.lit("\xa0"))), F.array("lang", F.lit("\t")))
    return table(spark, sf, "documents", heavy=True).select(
        "doc_id", F.posexplode(X.clean_texts(nested)).alias("pos", "cleaned"))


# -- replies ------------------------------------------------------------------

def _sql_text(v: str) -> str:
    return (f"CASE json_type({v}) WHEN 'BOOLEAN' THEN CASE WHEN {v}::VARCHAR = 'true' "
            f"THEN 'True' ELSE 'False' END ELSE json_extract_string({v}, '$') END")


def _sql_list(key: str) -> str:
    kept = (f"list_filter(CAST(j->'$.{key}' AS JSON[]), lambda v: v IS NOT NULL AND json_type(v) <> 'NULL' "
            f"AND v::VARCHAR NOT IN ('false', '0', '\"\"', '[]', '{{}}'))")
    return (f"CASE WHEN json_type(j, '$.{key}') = 'ARRAY' THEN array_to_string("
            f"list_transform({kept}, lambda v: {_sql_text('v')}), '|') ELSE '' END AS {key}")


def _sql_years(key: str) -> str:
    text = f"json_extract_string(j, '$.{key}')"
    return (f"CASE json_type(j, '$.{key}') WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match("
            f"trim({text}), '[+-]?\\d+') THEN CAST(trim({text}) AS INTEGER) END "
            f"WHEN 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 1 ELSE 0 END "
            f"WHEN 'DOUBLE' THEN CAST(trunc(CAST({text} AS DOUBLE)) AS INTEGER) "
            f"WHEN 'UBIGINT' THEN CAST({text} AS INTEGER) WHEN 'BIGINT' THEN CAST({text} AS INTEGER) END")


_MEMBER = "json_type(j, '$.{0}') = 'VARCHAR' AND json_extract_string(j, '$.{0}') IN ({1})"
_ROLES_IN = ", ".join(map(q, K.VALID_ROLES))
_LEVELS_IN = ", ".join(map(q, K.VALID_SENIORITY))


@case("extraction_validate", f"""WITH {REPLIES},
  parsed AS (SELECT doc_id, title, CASE WHEN json_valid(raw) AND coalesce(json_type(
    CASE WHEN json_valid(raw) THEN raw END, '$.role'), '') NOT IN ('ARRAY', 'OBJECT') AND coalesce(json_type(
    CASE WHEN json_valid(raw) THEN raw END, '$.seniority'), '') NOT IN ('ARRAY', 'OBJECT')
    THEN CAST(raw AS JSON) END AS j FROM replies),
  years AS (SELECT *, CASE WHEN json_type(j, '$.experience') IS NOT NULL THEN {_sql_years('experience')}
      ELSE {_sql_years('yearsexperience')} END AS yearsexperience,
    CASE WHEN {_MEMBER.format('seniority', _LEVELS_IN)} THEN json_extract_string(j, '$.seniority')
      ELSE 'Not specified' END AS named FROM parsed)
  SELECT doc_id, CASE WHEN j IS NULL OR json_type(j, '$.role') IS NULL THEN 'Other'
      WHEN {_MEMBER.format('role', _ROLES_IN)} THEN json_extract_string(j, '$.role')
      ELSE {sql_role('title')} END AS role,
    {sql_seniority('named', 'yearsexperience')} AS seniority,
    {sql_strip("nullif(json_extract_string(j, '$.description'), '')")} AS description,
    yearsexperience, {', '.join(map(_sql_list, LISTS))} FROM years""")
def _(spark, sf):
    rows = E.check_replies(replies(spark, sf))
    return rows.select("doc_id", "role", "seniority", "description", "yearsexperience",
                       *joined(*LISTS))


def _model():
    """Stands for a user's model: answers in JSON, fails on some postings."""
    def answer(title: str, description: str) -> str:
        if title == "Accountant":
            raise RuntimeError("refused")
        return json.dumps({"role": None if len(title) % 2 else "BI", "experience": len(title) % 9,
                           "skills_must": title.split(), "description": description})
    return answer


@case("model_extract", f"""WITH {JOBS}, asked AS (SELECT id, title, description,
    title <> 'Accountant' AS ok, len(title) % 9 AS y FROM jobs)
  SELECT id, title, CASE WHEN NOT ok THEN 'Other' WHEN len(title) % 2 = 1 THEN {sql_role('title')}
      ELSE 'BI' END AS role,
    CASE WHEN NOT ok THEN 'Not specified' ELSE {sql_seniority("'Not specified'", 'y')} END AS seniority,
    CASE WHEN ok THEN {sql_strip('description')} END AS description,
    CASE WHEN ok THEN CAST(y AS INTEGER) END AS yearsexperience,
    CASE WHEN ok THEN replace(title, ' ', '|') ELSE '' END AS skills_must, '' AS skills_nice,
    '' AS past_experience, 'linkedin' AS source FROM asked""")
def _(spark, sf):
    stubs = jobs(spark, sf, heavy=True).select("id", "title", "company", "location", "url", "keyword",
                                   "posted_at", F.col("description").alias("raw_description"))
    rows = E.job_rows(E.extract(stubs, _model()))
    return rows.select("id", "title", "role", "seniority", "description", "yearsexperience",
                       *joined(*LISTS), "source")


# Skills named in the postings of the rule queries, spelled as postings spell them and as the rules list them.
NAMED = (("Python", "python"), ("C++", "c++"), ("C#", "c#"), ("Node.js", "node.js"), ("terraform", "terraform"),
         ("Django", "django"), ("Kubernetes", "kubernetes"), ("machine learning", "machine learning"),
         ("React Native", "react|react native"), ("CI/CD", "ci/cd"), ("PostgreSQL", "postgresql"))
FIELDS = ("FinTech", "Mobile", "large scale distributed systems and payments")
# Levels that the titles of the rule queries name; the others name none.
_LEVEL = ("CASE WHEN title LIKE 'Senior %' THEN 'Senior' WHEN title LIKE '%Lead%' THEN 'Lead' "
          "WHEN title LIKE '%Manager%' THEN 'Manager' ELSE 'Not specified' END")


def _stated(spark, sf):
    """Documents with a sentence of requirements before and one of options after the text."""
    i = F.col("doc_id")
    names = [n for n, _ in NAMED]
    said = F.concat(F.lit("We ask for "), (i % 9).cast("string"),
                    F.when(i % 2 == 0, F.lit("+ years of experience in ")).otherwise(
                        F.lit("-12 years. Background in ")),
                    pick(FIELDS, i % 3), F.lit(", with "), pick(names, i % 11), F.lit(". "), "text", F.lit("\n"),
                    pick(names, (i + 5) % 11), F.lit(" is an Advantage. Founded 25 years ago"))
    return table(spark, sf, "documents", heavy=True).select("doc_id", pick(TITLES, i % 20).alias("title"),
                                                            said.alias("raw_description"))


@case("rule_extract", f"""WITH stated AS (SELECT doc_id, {sql_pick(TITLES, 'doc_id % 20')} AS title,
    CAST(doc_id % 9 AS INTEGER) AS y, {sql_pick(FIELDS, 'doc_id % 3')} AS field,
    {sql_pick([n for n, _ in NAMED], 'doc_id % 11')} AS first, {sql_pick([n for n, _ in NAMED], '(doc_id + 5) % 11')} AS last,
    {sql_pick([n for _, n in NAMED], 'doc_id % 11')} AS must, {sql_pick([n for _, n in NAMED], '(doc_id + 5) % 11')} AS nice,
    text FROM documents),
  levels AS (SELECT *, {_LEVEL} AS level FROM stated)
  SELECT doc_id, {sql_role('title')} AS role, {sql_seniority('level', 'y')} AS seniority,
    {sql_strip("'We ask for ' || y || CASE WHEN doc_id % 2 = 0 THEN '+ years of experience in ' ELSE '-12 years. Background in ' END || field || ', with ' || first || '. ' || text || chr(10) || last || ' is an Advantage. Founded 25 years ago'")} AS description,
    y AS yearsexperience, must AS skills_must, nice AS skills_nice, field AS past_experience FROM levels""")
def _(spark, sf):
    rows = E.extract(_stated(spark, sf)).withColumn("past_experience",
                                                    F.array_sort("past_experience"))
    return rows.select("doc_id", "role", "seniority", "description", "yearsexperience",
                       *joined(*LISTS))


# Phrases of postings and, by hand, what they say: years, level, required, optional, past experience.
PHRASES = (
    ("3\u20135 years of experience in SaaS", 3, "Junior", "", "", "SaaS"),
    ("3 to 5 years of experience with Python", 3, "Junior", "python", "", "Python"),
    ("Founded 25 years ago. 2 years of experience", 2, "Junior", "", "", ""),
    ("at least 3 yrs", 3, "Junior", "", "", ""),
    ("Must know sql\nNice to have:\n- Kafka\n- docker\n\nApply now", None, "Not specified", "sql", "kafka|docker", ""),
    ("We go above. Our network and platform grow", None, "Not specified", "", "", ""),
    ("120 years of experience", None, "Not specified", "", "", ""),
    ("background in large scale distributed systems and payments", None, "Not specified", "", "",
     "large scale distributed systems and payments"),
    ("4+ years of Backend development, C++ and .NET", 4, "Mid", "c++|.net", "", "Backend development"),
    ("worked as a Fullstack Developer (node.js)", None, "Not specified", "node.js", "", "Fullstack Developer"),
    ("8-10 years experience with C#; Azure preferred", 8, "Senior", "c#", "azure", "C#"),
    ("Experience as an SRE. Terraform a bonus", None, "Not specified", "", "terraform", "SRE"))


@case("rule_extract_phrases", f"""SELECT doc_id, p[2] AS seniority, TRY_CAST(p[1] AS INTEGER) AS yearsexperience,
    p[3] AS skills_must, p[4] AS skills_nice, p[5] AS past_experience FROM (SELECT doc_id,
    [{', '.join(sql_list(['' if x is None else str(x) for x in p[1:]]) for p in PHRASES)}][CAST(doc_id % 12 AS INTEGER) + 1]
    AS p FROM documents)""")
def _(spark, sf):
    """A phrase that postings use before each document's text, by rules."""
    phrase = F.get(F.array(*[F.lit(p[0]) for p in PHRASES]), (F.col("doc_id") % 12).cast("int"))
    stubs = table(spark, sf, "documents", heavy=True).select(
        "doc_id", F.lit("Clerk").alias("title"), F.concat(phrase, F.lit(".\n\n"), "text").alias("raw_description"))
    return E.extract(stubs).select("doc_id", "seniority", "yearsexperience", *joined(*LISTS))


# -- vector texts --------------------------------------------------------------

def sql_listed(name: str) -> str:
    return (f"coalesce(array_to_string(list_filter({name}, lambda x: x IS NOT NULL AND x <> ''), ', '), '')")


_NL = "chr(10)"
_FULL = sql_strip(
    f"'Job Title: ' || coalesce(title, 'None') || {_NL} || 'Role: ' || coalesce(role, 'None') || {_NL} "
    f"|| 'Seniority: ' || coalesce(seniority, 'None') || {_NL} || 'Company: ' || coalesce(company, 'None') "
    f"|| {_NL} || 'Location: ' || coalesce(location, 'None') || {_NL} || {_NL} || 'Required Skills: ' || "
    f"{sql_listed('skills_must')} || {_NL} || 'Nice Skills: ' || {sql_listed('skills_nice')} || {_NL} "
    f"|| 'Experience: ' || coalesce(CAST(yearsexperience AS VARCHAR), 'None') || ' years' || {_NL} "
    f"|| 'Past Experience: ' || {sql_listed('past_experience')} || {_NL} || {_NL} || 'Description:' "
    f"|| {_NL} || coalesce(description, 'None')")


def _sql_field(name: str) -> str:
    return sql_listed(name) if name.startswith("skills") else f"coalesce({sql_strip(name)}, '')"


VECTOR_TEXTS = f"""vector_texts AS (SELECT id || '_full' AS vector_id, id AS job_id, 'full' AS type,
    CAST(NULL AS VARCHAR) AS field, {_FULL} AS document FROM jobs UNION ALL
  SELECT id || '_' || field, id, 'field', field, document FROM ({' UNION ALL '.join(
      f"SELECT id, '{f}' AS field, {_sql_field(f)} AS document FROM jobs" for f in K.FIELD_VECTORS)})
  WHERE document <> '')"""


@case("full_text", f"WITH {JOBS} SELECT id, {_FULL} AS document FROM jobs")
def _(spark, sf):
    return jobs(spark, sf).select("id", J.full_text().alias("document"))


@case("field_vectors", f"WITH {JOBS}, {VECTOR_TEXTS} SELECT * FROM vector_texts")
def _(spark, sf):
    return vector_texts(jobs(spark, sf, heavy=True)).drop("metadata")


_META = [(c, f"coalesce(CAST({c} AS VARCHAR), '')") for c in (*K.METADATA_SCALARS, "posted_at")] + [
    (c, f"coalesce(array_to_string({c}, ', '), '')") for c in K.METADATA_LISTS]


@case("metadata_map", f"""WITH {JOBS}, {VECTOR_TEXTS}, meta AS ({' UNION ALL '.join(
    f"SELECT id AS job_id, '{k}' AS key, {v} AS value FROM jobs" for k, v in _META)})
  SELECT vector_id, key, value FROM vector_texts JOIN meta USING (job_id) UNION ALL
  SELECT vector_id, 'job_id', job_id FROM vector_texts UNION ALL
  SELECT vector_id, 'type', type FROM vector_texts UNION ALL
  SELECT vector_id, 'field', field FROM vector_texts WHERE field IS NOT NULL""")
def _(spark, sf):
    return vector_texts(jobs(spark, sf, heavy=True)).select("vector_id", F.explode("metadata"))


@case("vector_job_ids", f"""WITH {JOBS}, {VECTOR_TEXTS} SELECT DISTINCT
  regexp_replace(vector_id, '_[^_]*$', '') AS job_id FROM vector_texts""")
def _(spark, sf):
    return vector_texts(jobs(spark, sf)).select(
        J.job_of_vector(F.col("vector_id")).alias("job_id")).distinct()
