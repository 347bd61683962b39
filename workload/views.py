"""Postings-shaped views derived from the given tables, in Spark and in SQL.

Each view is arithmetic on ids over a whole table, spelled once for Spark and
once as a SQL table expression for the oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions.text import seniority_by_years
from joblode.session import spread

TITLES = ("Front-End Engineer", "Senior Backend Developer", "NLP Data Scientist", "BI Developer",
          "Studios Manager", "Senior QA", "QA Lead", "Engineering Manager", "Head of Product",
          "Product Software Engineer Manager", "Accountant", "Full Stack Developer",
          "DevOps Lead", "Cyber Analyst", "Firmware Specialist", "Solution Architect",
          "ETL Specialist", "Lead Data Scientist", "Test Engineer", "Manager of Product")
ROLES = ("Backend", "Frontend", "Data Scientist", "Data Engineer", "DevOps / Cloud", "Mobile",
         "Software Development", "AI / ML")
SKILLS = ("python", "sql", "spark", "docker", "react", "aws", "java")
PASTS = ("FinTech", "SaaS", "Backend development", "embedded systems")
AGES = ("{n} days ago", "{n} hours ago", "{n} weeks ago", "{n} months ago", "yesterday",
        "2024-02-{n}", "לפני {n} ימים", "just now", "{n} minutes ago", "posted 2024-13-45, {n} days")


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; ``heavy`` for costly work per row."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if heavy else rows


def pick(values: Sequence[str], index: Column) -> Column:
    listed = ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)
    return F.get(F.expr(f"array({listed})"), index.cast("int"))


def q(text: str) -> str:
    """A SQL text literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def sql_pick(values: Sequence[str], index: str) -> str:
    return f"{sql_list(values)}[CAST({index} AS INTEGER) + 1]"


def joined(*names: str) -> list[Column]:
    """List columns as text, to compare alike in every engine."""
    return [F.array_join(n, "|", "<null>").alias(n) for n in names]


def sql_joined(name: str) -> str:
    return (f"array_to_string(list_transform({name}, lambda x: coalesce(x, '<null>')), '|') AS {name}")


# -- jobs ---------------------------------------------------------------------

def jobs(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents", heavy)
    i = F.col("doc_id")
    years = F.when(i % 10 != 0, (i % 15).cast("int"))
    empty = F.array().cast("array<string>")
    return d.select(
        i.cast("string").alias("id"), pick(TITLES, i % 20).alias("title"),
        F.when(i % 17 != 0, pick(ROLES, i % 8)).alias("role"),
        seniority_by_years(F.lit("Not specified"), years).alias("seniority"),
        F.col("source").alias("company"), F.col("lang").alias("location"),
        F.concat(F.lit("https://jobs.example/view/x-"), (i + 1000000000).cast("string"),
                 F.lit("?ref=a")).alias("url"),
        F.col("text").alias("description"),
        F.when(i % 13 == 0, None).when(i % 11 == 0, empty).otherwise(
            F.array(pick(SKILLS, i % 7), pick(SKILLS, i % 5), pick(SKILLS, i % 3))
        ).alias("skills_must"),
        F.when(i % 9 == 0, empty).otherwise(
            F.array(pick(SKILLS, (i + 1) % 7), pick(SKILLS, (i + 3) % 7))).alias("skills_nice"),
        years.alias("yearsexperience"),
        F.array(pick(PASTS, i % 4)).alias("past_experience"),
        pick(K.KEYWORDS, i % len(K.KEYWORDS)).alias("keyword"),
        F.lit(K.DEFAULT_SOURCE).alias("source"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int")).alias("posted_at"),
        F.when(i % 19 != 0, F.lit("2024-03-01").cast("timestamp_ntz")
               + F.make_dt_interval(mins=i.cast("int"))).alias("scraped_at"))


JOBS = f"""jobs AS (SELECT CAST(doc_id AS VARCHAR) AS id,
  {sql_pick(TITLES, 'doc_id % 20')} AS title,
  CASE WHEN doc_id % 17 <> 0 THEN {sql_pick(ROLES, 'doc_id % 8')} END AS role,
  CASE WHEN doc_id % 10 = 0 THEN 'Not specified' WHEN doc_id % 15 <= 3 THEN 'Junior'
       WHEN doc_id % 15 <= 5 THEN 'Mid' ELSE 'Senior' END AS seniority,
  source AS company, lang AS location,
  'https://jobs.example/view/x-' || (1000000000 + doc_id) || '?ref=a' AS url,
  text AS description,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN CAST([] AS VARCHAR[])
       ELSE [{sql_pick(SKILLS, 'doc_id % 7')}, {sql_pick(SKILLS, 'doc_id % 5')},
             {sql_pick(SKILLS, 'doc_id % 3')}] END AS skills_must,
  CASE WHEN doc_id % 9 = 0 THEN CAST([] AS VARCHAR[])
       ELSE [{sql_pick(SKILLS, '(doc_id + 1) % 7')}, {sql_pick(SKILLS, '(doc_id + 3) % 7')}]
       END AS skills_nice,
  CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id % 15 AS INTEGER) END AS yearsexperience,
  [{sql_pick(PASTS, 'doc_id % 4')}] AS past_experience,
  {sql_pick(K.KEYWORDS, f'doc_id % {len(K.KEYWORDS)}')} AS keyword,
  {q(K.DEFAULT_SOURCE)} AS source,
  CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS posted_at,
  CASE WHEN doc_id % 19 <> 0
       THEN TIMESTAMP '2024-03-01' + to_minutes(CAST(doc_id AS BIGINT)) END AS scraped_at
  FROM documents)"""


# -- vectors ------------------------------------------------------------------

PARTS = ("full", *K.FIELD_VECTORS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors per job, out of the given embeddings."""
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    part = pick(PARTS, i % 8)
    job = F.floor(i / 8).cast("string")
    kind = F.when(i % 8 == 0, F.lit("full")).otherwise(F.lit("field"))
    return e.select(
        F.concat(job, F.lit("_"), part).alias("vector_id"), job.alias("job_id"),
        kind.alias("type"), F.when(i % 8 != 0, part).alias("field"),
        F.concat(F.lit("text "), i.cast("string")).alias("document"), "embedding",
        F.create_map(F.lit("job_id"), job, F.lit("label"), F.col("label").cast("string")
                     ).alias("metadata"))


VECTORS = f"""vectors AS (SELECT CAST(vec_id // 8 AS VARCHAR) || '_' || {sql_pick(PARTS, 'vec_id % 8')}
    AS vector_id, CAST(vec_id // 8 AS VARCHAR) AS job_id,
  CASE WHEN vec_id % 8 = 0 THEN 'full' ELSE 'field' END AS type,
  CASE WHEN vec_id % 8 <> 0 THEN {sql_pick(PARTS, 'vec_id % 8')} END AS field,
  'text ' || vec_id AS document, embedding, CAST(embedding AS DOUBLE[]) AS wide,
  CAST(label AS VARCHAR) AS label FROM embeddings)"""


# -- cards --------------------------------------------------------------------

def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sightings per job, under uneven keywords and three pages."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    n = len(K.KEYWORDS)
    order = ((i * i) % n).cast("int")
    return d.select(
        F.floor(i / 2).cast("string").alias("id"), pick(TITLES, i % 20).alias("title"),
        F.col("source").alias("company"), pick(K.KEYWORDS, order).alias("keyword"),
        order.alias("keyword_ord"), (F.floor(i / 7) % 3).cast("int").alias("page"),
        (i % 100000).cast("int").alias("position"), F.col("n_chars"))


CARDS = f"""cards AS (SELECT CAST(doc_id // 2 AS VARCHAR) AS id, {sql_pick(TITLES, 'doc_id % 20')} AS title,
  source AS company, {sql_pick(K.KEYWORDS, f'(doc_id * doc_id) % {len(K.KEYWORDS)}')} AS keyword,
  CAST((doc_id * doc_id) % {len(K.KEYWORDS)} AS INTEGER) AS keyword_ord,
  CAST((doc_id // 7) % 3 AS INTEGER) AS page, CAST(doc_id % 100000 AS INTEGER) AS position, n_chars
  FROM documents)"""


# -- stored pages -------------------------------------------------------------

CARDS_ON_PAGE = 3


def result_page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results page per given page: its own HTML, then 3 to 9 cards about its title."""
    p = table(spark, sf_dir, "pages", heavy=True)
    i = F.col("page_id")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)

    def card(k: Column) -> Column:
        number = i * 10 + k
        shown = F.when(number % 11 == 0, F.lit("  ")).otherwise(F.concat(title, F.lit(" \n "), k))
        link = F.when(number % 13 == 0, F.lit("")).otherwise(F.concat(
            F.lit('<a class="base-card__full-link x" href="https://jobs.example/view/dev-'),
            (number + 1000000).cast("string"), F.lit('?ref=a&amp;b=1">open</a>')))
        nested = (F.when(number % 5 == 0, F.lit("Plain Co"))
                  .when(number % 5 == 1, F.lit('<a class="hidden-nested-link"> </a> Outer <b>Co</b>'))
                  .otherwise(F.concat(F.lit('<a class="hidden-nested-link" href="#"> Co '),
                                      (number % 7).cast("string"), F.lit(" </a>"))))
        place = F.when(number % 3 == 0, F.lit("")).otherwise(
            F.lit('<span class="job-search-card__location">Tel <i>Aviv</i></span>'))
        return F.concat(F.lit('<li class="c"><div>'), link,
                        F.lit('<h3 class="base-search-card__title">'), shown, F.lit("</h3>"),
                        F.lit('<h4 class="base-search-card__subtitle">'), nested,
                        F.lit("</h4>"), place, F.lit("</div></li>\n"))

    last = (i % 7 + CARDS_ON_PAGE)
    listed = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), last), card), "")
    html = F.concat("html", F.lit('<ul class="jobs-search__results-list">'), listed, F.lit("</ul>"))
    keyword = F.replace(pick(K.KEYWORDS, i % len(K.KEYWORDS)), F.lit(" "), F.lit("%20"))
    url = F.concat(F.lit(K.SEARCH_BASE + "?keywords="), keyword, F.lit("&start="),
                   F.when(i % 2 == 0, F.lit("0")).otherwise(F.lit("25")))
    return p.select(url.alias("url"), html.alias("html"))


_UNESCAPED = "title"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                       ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, {q(_entity)}, {q(_char)})"

STUBS = f"""stubs AS (SELECT CAST(number + 1000000 AS VARCHAR) AS id, trim(
    regexp_replace({_UNESCAPED} || ' ' || k, ' +', ' ', 'g')) AS title,
  CASE WHEN number % 5 = 0 THEN 'N/A' WHEN number % 5 = 1 THEN 'Outer Co'
       ELSE 'Co ' || (number % 7) END AS company,
  CASE WHEN number % 3 = 0 THEN 'N/A' ELSE 'Tel Aviv' END AS location,
  'https://jobs.example/view/dev-' || (number + 1000000) AS url,
  {sql_pick(K.KEYWORDS, f'page_id % {len(K.KEYWORDS)}')} AS keyword,
  CAST(page_id % {len(K.KEYWORDS)} AS INTEGER) AS keyword_ord, CAST(page_id % 2 AS INTEGER) AS page,
  CAST(k - 1 AS INTEGER) AS position, page_id, number FROM (
    SELECT page_id, k, page_id * 10 + k AS number,
           regexp_extract(html, '<title>(.*?)</title>', 1) AS title
    FROM (SELECT page_id, html, unnest(range(1, page_id % 7 + {CARDS_ON_PAGE + 1})) AS k FROM pages))
  WHERE number % 11 <> 0 AND number % 13 <> 0)"""


def posting_page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting page per document, its text in one of four places or missing."""
    d = table(spark, sf_dir, "documents", heavy=True)
    i = F.col("doc_id")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"),
                               F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    short = F.lit('<div class="show-more-less-html__markup">too <b>short</b></div>')
    body = (F.when(i % 5 == 0, F.concat(
                F.lit('<div class="show-more-less-html__markup a">'), safe, F.lit("</div>")))
            .when(i % 5 == 1, F.concat(short, F.lit('<div class="description__text"><div>'), safe,
                                       F.lit("</div></div>")))
            .when(i % 5 == 2, F.concat(short, F.lit('<section class="core description">'), safe,
                                       F.lit("</section>")))
            .when(i % 5 == 3, F.concat(F.lit('<div class="core-section-container__content">'
                                             "<script>var x = '<p>';</script>"), safe,
                                       F.lit("</div>")))
            .otherwise(short))
    day = F.lpad((i % 28 + 1).cast("string"), 2, "0")
    ago = F.concat((i % 9 + 1).cast("string"), F.lit(" days ago"))
    posted = (F.when(i % 4 == 0, F.concat(F.lit('<time datetime="2024-02-'), day, F.lit('">x</time>')))
              .when(i % 4 == 1, F.concat(F.lit('<time class="posted-time-ago__text"> '), ago,
                                         F.lit("</time>")))
              .when(i % 4 == 2, F.concat(F.lit('<em class="topcard__flavor--metadata">'), ago,
                                         F.lit("</em>"))).otherwise(F.lit("")))
    html = F.concat(F.lit("<html><body><div>top</div>"), body, posted, F.lit("</body></html>"))
    return d.select(F.concat(F.lit(K.DETAIL_BASE), i.cast("string")).alias("url"),
                    html.alias("html"))


_SHOWN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
DETAILS = f"""details AS (SELECT CAST(doc_id AS VARCHAR) AS id, body AS raw_description,
  CASE WHEN body = 'N/A' THEN NULL WHEN doc_id % 4 = 0
       THEN CAST('2024-02-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS DATE)
       WHEN doc_id % 4 < 3 THEN CAST(DATE '2024-03-10' - CAST(doc_id % 9 + 1 AS INTEGER) AS DATE)
  END AS posted_at FROM (SELECT doc_id, CASE WHEN doc_id % 5 < 4 AND len({_SHOWN}) > 50
       THEN {_SHOWN} ELSE 'N/A' END AS body FROM documents))"""


# -- replies ------------------------------------------------------------------

REPLY_FIELDS = (
    '"role":"QA / Automation","experience":"3",', '"role":null,', "",
    '"experience":null,"yearsexperience":5,', '"experience":3.7,"seniority":"Lead",',
    '"experience":"3.7",', '"experience":"5+","seniority":"Intern",',
    '"skills_must":["a",null,"",0,"0",false,true,2.5],', '"skills_must":"python","skills_nice":[],',
    '"role":"backend","experience":-2.9,', "oops", '"role":["x"],', '"seniority":{"a":1},',
    '"experience":true,"past_experience":["FinTech"," "],',
    '"role":"Other","experience":12,"seniority":"Manager",', '"experience":" 8 ",',
    '"yearsexperience":4,"seniority":"Intern",')


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies that carry a document's whole text as description."""
    d = table(spark, sf_dir, "documents", heavy=True)
    i = F.col("doc_id")
    about = F.to_json(F.struct(F.col("text").alias("description")))
    body = F.concat(F.lit("{"), pick(REPLY_FIELDS, i % len(REPLY_FIELDS)),
                    F.substring(about, 2, 1 << 30))
    raw = (F.when(i % 23 == 0, None).when(i % 3 == 0, body)
           .when(i % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" done."))))
    return d.select("doc_id", pick(TITLES, i % 20).alias("title"), raw.alias("raw"),
                    F.when(i % 29 == 0, F.lit("N/A")).otherwise(F.col("text")
                                                                ).alias("raw_description"))


REPLIES = f"""replies AS (SELECT doc_id, {sql_pick(TITLES, 'doc_id % 20')} AS title, text,
  CASE WHEN doc_id % 23 <> 0 AND doc_id % 29 <> 0
       THEN '{{' || {sql_pick(REPLY_FIELDS, f'doc_id % {len(REPLY_FIELDS)}')}
            || '"description":' || CAST(to_json(text) AS VARCHAR) || '}}' END AS raw
  FROM documents)"""


# -- transcripts --------------------------------------------------------------

def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose assistant turns call up to two tools."""
    c = table(spark, sf_dir, "conversations")
    i = F.col("conv_id") + F.col("turn")
    one, two = pick(K.TOOL_NAMES, i % 7), pick(K.TOOL_NAMES, (i * 3 + 1) % 7)
    calls = (F.when(F.col("role") != "assistant", F.lit(None).cast("array<string>"))
             .when(i % 3 == 0, F.array().cast("array<string>"))
             .when(i % 3 == 1, F.array(one)).otherwise(F.array(one, two)))
    return c.select("conv_id", "turn", "role", "text", calls.alias("tool_calls"))


TRANSCRIPTS = f"""transcripts AS (SELECT conv_id, turn, role, text,
  CASE WHEN role <> 'assistant' THEN NULL WHEN i % 3 = 0 THEN CAST([] AS VARCHAR[])
       WHEN i % 3 = 1 THEN [{sql_pick(K.TOOL_NAMES, 'i % 7')}]
       ELSE [{sql_pick(K.TOOL_NAMES, 'i % 7')}, {sql_pick(K.TOOL_NAMES, '(i * 3 + 1) % 7')}]
  END AS tool_calls FROM (SELECT *, conv_id + turn AS i FROM conversations))"""
