"""Harvest, quota, inserts, stage files and whole runs over derived pages."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from joblode import constants as K
from joblode.operators import harvest as H
from joblode.operators.keys import take_first
from joblode.plans import ingest as P
from joblode.schemas import STUB_SCHEMA
from joblode.session import scratch
from joblode.sources import frontier as R
from joblode.sources import stages as G
from joblode.sources import tables as B
from joblode.sources.idindex import build_index, read_index
from workload.registry import case
from workload.texts import sql_role
from workload.views import (CARDS, DETAILS, JOBS, STUBS, cards, jobs, posting_page_html, q,
                            result_page_html, table)

NOW = datetime(2024, 3, 10, 2, 0)
N_KEYWORDS = len(K.KEYWORDS)


@case("search_frontier", f"""WITH keywords AS (SELECT min(doc_id) AS keyword_ord,
    lang || ' ' || source AS keyword FROM documents GROUP BY ALL)
  SELECT keyword_ord, keyword, "offset", {q(K.SEARCH_BASE)} || '?keywords=' || replace(keyword, ' ', '%20')
    || '&location=Israel&sortBy=DD&start=' || "offset" || '&f_TPR={K.SEARCH_RECENCY}' AS url
  FROM keywords, (VALUES (0), (25)) AS o("offset")""")
def _(spark, sf):
    words = table(spark, sf, "documents").groupBy(
        F.concat_ws(" ", "lang", "source").alias("keyword")).agg(
        F.min("doc_id").alias("keyword_ord"))
    return R.search_frontier(words.select("keyword_ord", "keyword"), (0, 25))


@case("detail_urls", f"WITH {JOBS} SELECT id, {q(K.DETAIL_BASE)} || id AS url FROM jobs")
def _(spark, sf):
    return jobs(spark, sf).select("id", R.detail_url(F.col("id")).alias("url"))


def result_pages(spark, sf):
    return R.result_pages(result_page_html(spark, sf), R.keyword_seeds(spark), N_KEYWORDS)


@case("harvest_cards", f"""WITH {STUBS} SELECT id, title, company, location, url, keyword, keyword_ord,
    page, position FROM stubs""")
def _(spark, sf):
    return H.read_cards(result_pages(spark, sf))


@case("harvest_details", f"WITH {DETAILS} SELECT * FROM details")
def _(spark, sf):
    return H.read_details(R.detail_pages(posting_page_html(spark, sf)), NOW)


_FIRST = """first AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY id ORDER BY keyword_ord, page, position) AS nth FROM cards) WHERE nth = 1)"""


@case("first_seen", f"""WITH {CARDS}, {_FIRST} SELECT id, title, keyword, keyword_ord, page, position
  FROM first""")
def _(spark, sf):
    return H.first_seen(cards(spark, sf)).drop("company", "n_chars")


@case("daily_quota", f"""WITH {CARDS}, {_FIRST} SELECT id, keyword FROM first
  ORDER BY keyword_ord, page, position, id LIMIT 38""")
def _(spark, sf):
    return H.daily_quota(H.first_seen(cards(spark, sf)), done_today=12).select("id", "keyword")


@case("quota_by_ranges", f"""WITH {CARDS}, {_FIRST} SELECT id, keyword FROM first
  ORDER BY keyword_ord, page, position, id LIMIT (SELECT count(*) FROM labels)""")
def _(spark, sf):
    """A cut as large as a table, found from ranges rather than by a top-n."""
    size = table(spark, sf, "labels").count()
    return take_first(H.first_seen(cards(spark, sf)), (*H.ARRIVAL, "id"), size,
                      top_rows=5).select("id", "keyword")


_OPENED = """opened AS (SELECT c.* FROM cards c WHERE page < 2 AND (page = 0 OR (
    SELECT count(*) FROM cards p WHERE p.keyword_ord = c.keyword_ord AND p.page = 0) >= 5))"""


@case("page_rule", f"WITH {CARDS}, {_OPENED} SELECT id, keyword_ord, page, position FROM opened")
def _(spark, sf):
    return H.page_rule(cards(spark, sf), n_keywords=N_KEYWORDS).select(
        "id", "keyword_ord", "page", "position")


def _in_turn() -> str:
    """One keyword after another: does it open its second page, and what has been taken then."""
    steps = ["least AS (SELECT count(*) // 18 AS n FROM documents)", "t0 AS MATERIALIZED (SELECT id FROM cards WHERE false)"]
    for k in range(N_KEYWORDS):
        steps.append(f"""o{k} AS MATERIALIZED (SELECT {k} AS keyword_ord, count(*) >= any_value(least.n) AS more
  FROM cards, least WHERE keyword_ord = {k} AND page = 0 AND id NOT IN (SELECT id FROM t{k}))""")
        steps.append(f"""t{k + 1} AS MATERIALIZED (SELECT id FROM t{k} UNION SELECT id FROM cards, o{k}
  WHERE cards.keyword_ord = {k} AND (page = 0 OR (page = 1 AND more)))""")
    opened = " UNION ALL ".join(f"SELECT * FROM o{k}" for k in range(N_KEYWORDS))
    return ", ".join([*steps, f"opened AS ({opened})"])


@case("page_rule_in_turn", f"""WITH {CARDS}, {_in_turn()} SELECT id, cards.keyword_ord, page, position
  FROM cards JOIN opened ON opened.keyword_ord = cards.keyword_ord WHERE page = 0 OR (page = 1 AND more)""")
def _(spark, sf):
    """Second pages open for keywords that show many postings no earlier keyword took."""
    least = table(spark, sf, "documents").count() // 18
    return H.page_rule_in_turn(cards(spark, sf), min_cards=least, n_keywords=N_KEYWORDS).select(
        "id", "keyword_ord", "page", "position")


@case("harvest_stats", f"""WITH {CARDS}, {_FIRST}, c AS (SELECT keyword, count(*) AS cards,
    count(*) AS fetched, avg(n_chars / 1000.0) AS avg_seconds FROM cards GROUP BY keyword),
  n AS (SELECT keyword, count(*) AS n FROM first GROUP BY keyword)
  SELECT keyword, cards, coalesce(n, 0) AS new, fetched, round(avg_seconds, 6) AS avg_seconds
  FROM c LEFT JOIN n USING (keyword)""")
def _(spark, sf):
    all_cards = cards(spark, sf)
    fetches = all_cards.select("keyword", (F.col("n_chars") / 1000.0).alias("seconds"))
    return H.harvest_stats(all_cards, H.first_seen(all_cards), fetches).withColumn(
        "avg_seconds", F.round("avg_seconds", 6))


def _incoming(spark, sf):
    """Postings seen twice each under one id, the first by keyword to be kept."""
    both = jobs(spark, sf).withColumn("seen", F.col("id").cast("bigint"))
    return both.withColumn("id", F.floor(F.col("seen") / 2).cast("string"))


_INCOMING = f"""incoming AS (SELECT * EXCLUDE (id, nth) , new_id AS id FROM (
    SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY keyword, CAST(id AS BIGINT)) AS nth
    FROM (SELECT *, CAST(CAST(id AS BIGINT) // 2 AS VARCHAR) AS new_id FROM jobs)) WHERE nth = 1),
  stored AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM labels)"""


@case("insert_new", f"""WITH {JOBS}, {_INCOMING} SELECT id, title, keyword FROM incoming
  WHERE id NOT IN (SELECT id FROM stored)""")
def _(spark, sf):
    stored = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return B.new_jobs(_incoming(spark, sf), stored, ("keyword", "seen")).select(
        "id", "title", "keyword")


@case("insert_into_table", f"""WITH {JOBS}, {_INCOMING},
  old AS (SELECT id, title, keyword, CAST(scraped_at AS DATE) AS day FROM jobs
    WHERE id IN (SELECT id FROM stored)),
  new AS (SELECT id, title, keyword, CAST(scraped_at AS DATE) AS day FROM incoming
    WHERE id NOT IN (SELECT id FROM stored))
  SELECT id, title, keyword, coalesce(day, DATE '2024-03-10') AS day FROM (
    SELECT * FROM old UNION ALL SELECT * FROM new)""")
def _(spark, sf):
    """Two loads into a fresh table, the second with repeats of its own and of stored ids."""
    path = scratch(spark, "jobs-table")
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    B.insert_jobs(spark, path, jobs(spark, sf).join(labels, "id", "left_semi"), as_of=NOW)
    for _ in range(2):  # delivered twice, as after a failure
        B.insert_jobs(spark, path, _incoming(spark, sf), as_of=NOW, arrival=("keyword", "seen"))
    return B.read_jobs(spark, path).select("id", "title", "keyword", F.col("scraped_on").alias("day"))


@case("insert_indexed", f"""WITH {JOBS}, {_INCOMING},
  old AS (SELECT id, title, keyword, CAST(scraped_at AS DATE) AS day FROM jobs
    WHERE id IN (SELECT id FROM stored)),
  new AS (SELECT id, title, keyword, CAST(scraped_at AS DATE) AS day FROM incoming
    WHERE id NOT IN (SELECT id FROM stored)),
  loaded AS (SELECT id, title, keyword, coalesce(day, DATE '2024-03-10') AS day FROM (
    SELECT * FROM old UNION ALL SELECT * FROM new))
  SELECT *, 1 AS times_indexed FROM loaded""")
def _(spark, sf):
    """The same loads, looked up in an index of the ids; also how often each posting is indexed."""
    path = scratch(spark, "jobs-table")
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    B.insert_jobs(spark, path, jobs(spark, sf).join(labels, "id", "left_semi"), as_of=NOW)
    build_index(spark, path, B.read_jobs(spark, path))
    for _ in range(2):  # delivered twice, as after a failure
        B.insert_jobs(spark, path, _incoming(spark, sf), as_of=NOW, arrival=("keyword", "seen"), by_index=True)
    loaded = B.read_jobs(spark, path).select("id", "title", "keyword", F.col("scraped_on").alias("day"))
    times = read_index(spark, path).groupBy("hash").agg(F.count(F.lit(1)).alias("times_indexed"))
    return loaded.join(times, F.xxhash64("id") == F.col("hash"), "left").drop("hash")


@case("load_counters", f"""WITH {JOBS}, {_INCOMING} SELECT (SELECT count(*) FROM jobs) AS sent,
  (SELECT count(*) FROM incoming) AS inserted""")
def _(spark, sf):
    counts = B.insert_jobs(spark, scratch(spark, "jobs-table"), _incoming(spark, sf), as_of=NOW)
    return spark.createDataFrame([(counts.sent, counts.inserted)], "sent long, inserted long")


@case("stage_round_trip", f"""WITH {STUBS} SELECT id, title, company, location, url,
    CAST(NULL AS VARCHAR) AS raw_description, '2024-03-10' AS posted_at, keyword, keyword_ord, page,
    position FROM stubs""")
def _(spark, sf):
    stubs = H.read_cards(result_pages(spark, sf)).withColumns(
        {"raw_description": F.lit(None).cast("string"),
         "posted_at": F.lit("2024-03-10").cast("date")}).select(*STUB_SCHEMA.names)
    path = G.stage_path(scratch(spark, "stage"), "run_2024-03-10T02:00:00+00:00", "stubs")
    G.write_stage(stubs, path)
    return G.read_stage(spark, path, STUB_SCHEMA)


def posting_pages(spark, sf):
    """Posting pages for the jobs of the derived result pages, one per card with text."""
    p = table(spark, sf, "pages")
    number = F.explode(F.sequence(F.col("page_id") * 10 + 1, F.col("page_id") * 10 + 9))
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    rows = p.select(title.alias("title"), number.alias("number"))
    body = F.concat(F.lit('<div class="show-more-less-html__markup">We need 4+ years of experience in '
                          'SaaS and python. '), "title",
                    F.lit("<br>sql is a bonus</div><time datetime='2024-02-"),
                    F.lpad((F.col("number") % 28 + 1).cast("string"), 2, "0"), F.lit("'>x</time>"))
    html = F.when(F.col("number") % 17 == 0, F.lit("<p>This posting is gone</p>")).otherwise(body)
    return R.detail_pages(rows.select(
        R.detail_url((F.col("number") + 1000000).cast("string")).alias("url"), html.alias("html")))


_RUN = f"""{STUBS}, opened AS (SELECT c.*, (SELECT count(*) FROM stubs s
    WHERE s.keyword_ord = c.keyword_ord AND s.page = 0) AS before FROM stubs c),
  kept AS (SELECT * FROM opened WHERE page = 0 OR before >= 5
    ORDER BY keyword_ord, page, position, id LIMIT 300)"""


def _run(spark, sf):
    jobs_path, vectors_path = scratch(spark, "run-jobs"), scratch(spark, "run-vectors")
    pages, details = result_pages(spark, sf), posting_pages(spark, sf)
    counts = P.run_all(spark, pages, details, jobs_path, vectors_path, as_of=NOW, target=300,
                       n_keywords=N_KEYWORDS)
    return jobs_path, vectors_path, counts


@case("ingest_run", f"""WITH {_RUN}, base AS (SELECT *, number % 17 <> 0 AS read FROM kept)
  SELECT id, title, company, location, url, keyword, 'linkedin' AS source,
    CASE WHEN read THEN {sql_role('title')} ELSE 'Other' END AS role,
    CASE WHEN read THEN 'Mid' ELSE 'Not specified' END AS seniority,
    CASE WHEN read THEN 4 END AS yearsexperience,
    CASE WHEN read THEN 'python' ELSE '' END AS skills_must,
    CASE WHEN read THEN 'sql' ELSE '' END AS skills_nice,
    CASE WHEN read THEN 'SaaS and python' ELSE '' END AS past_experience,
    CASE WHEN read THEN CAST('2024-02-' || lpad(CAST(number % 28 + 1 AS VARCHAR), 2, '0') AS DATE) END
      AS posted_at, DATE '2024-03-10' AS day FROM base""")
def _(spark, sf):
    """Harvest, extraction by rules, load and vectors; the second run of the day finds no room."""
    path, vectors_path, _ = _run(spark, sf)
    P.run_all(spark, result_pages(spark, sf), posting_pages(spark, sf), path, vectors_path,
              as_of=NOW, target=300, n_keywords=N_KEYWORDS)
    lists = [F.array_join(c, "|").alias(c) for c in ("skills_must", "skills_nice",
                                                    "past_experience")]
    return B.read_jobs(spark, path).select(
        "id", "title", "company", "location", "url", "keyword", "source", "role", "seniority",
        "yearsexperience", *lists, "posted_at", F.col("scraped_on").alias("day"))


@case("ingest_run_vectors", f"""WITH {_RUN} SELECT unnest(CASE WHEN number % 17 <> 0
    THEN ['full', 'skills_must', 'skills_nice', 'description', 'title', 'role', 'company', 'location']
    ELSE ['full', 'title', 'role', 'company', 'location'] END) AS part, id || '_' || part AS vector_id
  FROM kept""")
def _(spark, sf):
    _, vectors_path, _ = _run(spark, sf)
    return B.read_vectors(spark, vectors_path).select(
        F.coalesce("field", "type").alias("part"), "vector_id")


@case("catalog_table", f"""WITH {JOBS}, {_INCOMING} SELECT id, title, coalesce(CAST(scraped_at AS DATE),
    DATE '2024-03-10') AS day FROM incoming""")
def _(spark, sf):
    """Two loads of the same postings by the table's name, read by its name."""
    name = f"jobs_{uuid.uuid4().hex}"
    B.create_jobs_table(spark, name, scratch(spark, "catalog"))
    for _ in range(2):
        B.insert_into_catalog(spark, name, _incoming(spark, sf), as_of=NOW, arrival=("keyword", "seen"))
    return spark.table(name).select("id", "title", F.col("scraped_on").alias("day"))


@case("ingest_run_stages", f"""WITH {_RUN} SELECT id, title, keyword, CASE WHEN number % 17 <> 0 THEN 4 END
    AS yearsexperience FROM kept""")
def _(spark, sf):
    """A run that hands over stage files; a second one starts from them and loads nothing new."""
    jobs_path, vectors_path, stages = (scratch(spark, n) for n in ("run-jobs", "run-vectors", "stages"))
    for _ in range(2):
        P.run_all(spark, result_pages(spark, sf), posting_pages(spark, sf), jobs_path, vectors_path, as_of=NOW,
                  target=300, n_keywords=N_KEYWORDS, stages=stages, run_id="2024-03-10T02:00:00+00:00")
    return B.read_jobs(spark, jobs_path).select("id", "title", "keyword", "yearsexperience")
