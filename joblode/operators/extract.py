"""Extraction: by a user's model or by rules, then checked in column code."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions.reply import (checked_fields, empty_extraction, no_description,
                                     parse_fields)
from joblode.functions.text import contains_any, infer_role, let, seniority_by_years, strip
from joblode.schemas import EXTRACTION_SCHEMA, STAGED_COLUMNS


def usable_reply(reply: str | None) -> bool:
    """Whether a reply holds one JSON object whose role and level are texts, if they are there."""
    if reply is None or (start := reply.find("{")) < 0:
        return False
    try:
        fields = json.loads(reply[start:reply.rfind("}") + 1])
    except ValueError:
        return False
    return isinstance(fields, dict) and all(
        fields.get(n) is None or isinstance(fields[n], (str, int, float)) for n in ("role", "seniority"))


def model_replies(stubs: DataFrame, model: Callable | None = None, *, attempts: int = 3,
                  load: Callable[[], Callable] | None = None, batched: bool = False) -> DataFrame:
    """Adds ``raw``, the last that a model returned in up to ``attempts`` tries.

    ``model(title, description)`` gives one reply; with ``batched`` it takes two
    lists and gives a list of replies. ``load()`` returns the model and is called
    once per task, so that a large model is not shipped with the plan. Only the
    two texts travel to Python, in Arrow batches. A posting without a description
    is not asked about. A call that fails, or a reply that cannot be used, is
    tried again. :func:`unanswered` tells which rows got no usable reply.
    """
    if (model is None) == (load is None):
        raise ValueError("give either a model or a function that loads one")

    def answers(asked, titles: list, texts: list) -> list:
        try:
            return list(asked(titles, texts)) if batched else [asked(t, d) for t, d in zip(titles, texts)]
        except Exception:  # noqa: BLE001 - any failure of a user's model is a missing reply
            return [None] * len(titles) if batched else [one(asked, t, d) for t, d in zip(titles, texts)]

    def one(asked, title, text):
        try:
            return asked(title, text)
        except Exception:  # noqa: BLE001
            return None

    @F.pandas_udf("string")
    def replies(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        asked = model if load is None else load()
        for titles, texts in batches:
            found: list = [None] * len(titles)
            left = [n for n, d in enumerate(texts) if d is not None]
            for _ in range(attempts):
                if not left:
                    break
                got = answers(asked, [titles.iloc[n] for n in left], [texts.iloc[n] for n in left])
                for n, reply in zip(left, got):
                    found[n] = reply if reply is not None else found[n]
                left = [n for n, reply in zip(left, got) if not usable_reply(reply)]
            yield pd.Series(found, dtype=object)

    asked = F.when(~no_description(F.col("raw_description")), F.col("raw_description"))
    return stubs.withColumn("raw", replies("title", asked))


def unanswered(replies: DataFrame) -> Column:
    """Whether a row that was asked about has no reply that parses."""
    asked = ~no_description(F.col("raw_description"))
    return asked & (F.col("raw").isNull() | parse_fields(F.col("raw")).isNull())


def check_replies(replies: DataFrame) -> DataFrame:
    """Adds the extraction's columns to rows with ``raw, title, raw_description``."""
    parsed = replies.withColumn("_fields", parse_fields(F.col("raw")))
    checked = checked_fields(F.col("_fields"), F.col("title"), F.col("raw_description"))
    return _with_extraction(parsed.withColumn("_x", checked).drop("_fields", "raw"))


def _with_extraction(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c != "_x"]
    return df.select(*kept, *[F.col(f"_x.{n}").alias(n) for n in EXTRACTION_SCHEMA.names])


# Names of technologies and methods that the rules look for, in lower case, as whole words.
SKILLS = (
    "python", "java", "javascript", "typescript", "golang", "ruby", "php", "kotlin", "scala", "rust", "swift",
    "c++", "c#", ".net", "perl", "matlab", "bash", "powershell", "solidity", "elixir", "erlang", "haskell",
    "react", "react native", "angular", "vue", "vue.js", "svelte", "next.js", "node.js", "nestjs", "express.js",
    "html", "css", "sass", "tailwind", "webpack", "jquery", "redux", "graphql", "rest api", "grpc", "websocket",
    "django", "flask", "fastapi", "spring boot", "hibernate", "laravel", "symfony", "ruby on rails", "asp.net",
    "android", "ios", "flutter", "xamarin", "unity", "unreal engine", "opengl",
    "sql", "nosql", "mysql", "postgres", "postgresql", "mongodb", "redis", "cassandra", "dynamodb", "oracle",
    "sql server", "sqlite", "elasticsearch", "opensearch", "neo4j", "clickhouse", "snowflake", "bigquery",
    "redshift", "databricks", "spark", "pyspark", "hadoop", "hive", "flink", "kafka", "rabbitmq", "airflow", "dbt",
    "pandas", "numpy", "scikit-learn", "tensorflow", "pytorch", "keras", "opencv", "hugging face", "langchain",
    "machine learning", "deep learning", "nlp", "llm", "computer vision", "big data", "etl", "data warehouse",
    "tableau", "power bi", "looker", "qlik", "excel",
    "aws", "azure", "gcp", "google cloud", "docker", "kubernetes", "helm", "terraform", "ansible", "puppet", "chef",
    "jenkins", "github actions", "gitlab", "git", "ci/cd", "devops", "prometheus", "grafana", "datadog", "splunk",
    "linux", "unix", "windows server", "tcp/ip", "vmware", "openstack", "nginx", "serverless", "microservices",
    "siem", "owasp", "penetration testing", "active directory", "okta", "wireshark",
    "selenium", "cypress", "playwright", "appium", "junit", "pytest", "postman", "jmeter",
    "verilog", "vhdl", "fpga", "rtos", "embedded linux", "labview", "plc",
    "salesforce", "sap", "servicenow", "jira", "agile", "scrum")

# "3-5 years", "3 to 5 yrs", "8+ years": the lower bound, a whole number.
_YEARS = r"(?<![\w.,/-])(\d{1,2})(?![\d.])\s*(?:\+|(?:-|\u2013|\u2014|to)\s*\d{1,2}\s*\+?)?\s*(?:years?|yrs?)\b(?!\s+ago|\s+old)"
# Words that make a sentence one about experience.
_EXPERIENCE = r"experience|background|hands-on|at least|minimum|require|looking for|ask for|you have|must|years? of\b|yrs? of\b"
# What follows the usual phrases, to the end of the clause, however long.
_PAST = (r"(?:(?:years?|yrs?)(?: of)? experience (?:in|with)|background in|"
         r"experience as an?|worked as an?)\s+([^.,;:()\n]+)")
_DEVELOPMENT = r"(?:years?|yrs?) of ((?!experience)[^.,;:()\n]+? (?:development|engineering))"
_SENTENCE = r"[;\n]+|\.(?=\s|$)"
# A heading with a word of option, and the lines of its list up to a blank line or another heading.
_LISTED = (r"(?im)^[^\n:]*(?:" + "|".join(K.OPTIONAL_MARKS) + r")[^\n:]*:[ \t]*\n"
           r"((?:(?![^\n]*:[ \t]*$)[ \t]*\S[^\n]*(?:\n|\z))+)")
_TITLE_LEVELS = ("Intern", "Junior", "Mid", "Senior", "Lead", "Staff", "Principal", "Manager",
                 "Director", "VP")


def _words(text: Column) -> Column:
    """Blank-separated lower-case words with a blank at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}+#&]+", " "),
                    F.lit(" "))


def _spelled(skill: str) -> str:
    """A skill as :func:`_words` shows it."""
    return " ".join(re.sub(r"[^\w+#&]+", " ", skill.lower()).split())


def _named(text: Column, skills: Sequence[str]) -> Column:
    """Skills named in a text, in the order of the list.

    Skills of one word come from a set intersection with the text's words; only
    the few of several words are searched for.
    """
    shown = {s: _spelled(s) for s in skills}
    single, several = [s for s in skills if " " not in shown[s]], [s for s in skills if " " in shown[s]]
    literal = lambda values: F.array(*map(F.lit, values)).cast("array<string>")

    # Skills by the word that they show as: two spellings of one word are two skills.
    by_word: dict[str, list[str]] = {}
    for s in single:
        by_word.setdefault(shown[s], []).append(s)
    names = F.create_map(*[x for w, own in by_word.items() for x in (F.lit(w), literal(own))]) if by_word else None

    def find(words: Column) -> Column:
        # Only words that are skills are looked up, a few per text.
        held = F.array_intersect(F.split(words, " "), literal(list(by_word)))
        one = F.flatten(F.transform(held, lambda w: F.element_at(names, w))) if by_word else literal([])
        phrases = F.filter(F.arrays_zip(literal(several).alias("skill"), literal(
            [shown[s] for s in several]).alias("shown")), lambda p: F.contains(
                words, F.concat(F.lit(" "), p["shown"], F.lit(" "))))
        return F.concat(one, F.transform(phrases, lambda p: p["skill"]))

    if not skills:
        return F.array().cast("array<string>")
    return let(let(_words(text), find), lambda found: F.array_intersect(literal(skills), found))


def rule_extraction(stubs: DataFrame, skills: Sequence[str] = SKILLS) -> DataFrame:
    """Adds ``_x``, an extraction by rules over the whole text, for use without a model.

    Years: the largest lower bound in a sentence about experience. Skills: the
    names in ``skills``, as whole words; those in a sentence with a word of option,
    or in a list under a heading with one, are nice to have, all others required.
    Past experience: what follows the usual phrases, to the end of the clause.
    Role and seniority: by title, the latter overruled by years.
    """
    title, text = F.col("title"), F.col("raw_description")

    level = F
    for name in _TITLE_LEVELS:
        level = level.when(F.col("_title").contains(f" {name.lower()} "), F.lit(name))
    level = level.otherwise(F.lit(K.DEFAULT_SENIORITY))
    marked = F.transform(F.split(F.lower("_rest"), _SENTENCE), lambda s: F.struct(
        s.alias("text"), contains_any(s, K.OPTIONAL_MARKS).alias("optional")))
    years = F.flatten(F.transform(
        F.filter(F.split(F.lower(text), _SENTENCE), lambda s: s.rlike(_EXPERIENCE)),
        lambda s: F.transform(F.regexp_extract_all(s, F.lit(_YEARS), 1), lambda n: n.cast("int"))))
    past = F.concat(F.regexp_extract_all(text, F.lit("(?i)" + _PAST), 1),
                    F.regexp_extract_all(text, F.lit("(?i)" + _DEVELOPMENT), 1))
    # Projections in steps: what a later step uses more than once is kept as a column.
    parts = stubs.withColumns({
        "_title": _words(title), "_listed": F.regexp_extract_all(text, F.lit(_LISTED), 1),
        "_rest": F.regexp_replace(text, _LISTED, "\n"), "_years": F.array_max(years),
        "_past": F.array_distinct(F.transform(past, strip))})
    parts = parts.withColumn("_marked", marked)
    parts = parts.withColumns({
        "_must": F.array_join(F.transform(F.filter("_marked", lambda s: ~s["optional"]),
                                          lambda s: s["text"]), " . "),
        "_nice": F.concat_ws(" . ", F.transform(F.filter("_marked", lambda s: s["optional"]),
                                                lambda s: s["text"]), "_listed")})
    parts = parts.withColumns({"_must": _named(F.col("_must"), skills),
                               "_nice": _named(F.col("_nice"), skills)})
    full = F.struct(infer_role(title).alias("role"),
                    seniority_by_years(level, F.col("_years")).alias("seniority"),
                    F.when(strip(text) != "", strip(text)).alias("description"),
                    F.col("_years").alias("yearsexperience"), F.col("_must").alias("skills_must"),
                    F.array_except("_nice", "_must").alias("skills_nice"),
                    F.col("_past").alias("past_experience"))
    extraction = F.when(no_description(text), empty_extraction().cast(EXTRACTION_SCHEMA)
                        ).otherwise(full.cast(EXTRACTION_SCHEMA))
    return parts.withColumn("_x", extraction).drop(
        "_title", "_listed", "_rest", "_marked", "_must", "_nice", "_years", "_past")


def extract(stubs: DataFrame, model: Callable | None = None, *, skills: Sequence[str] = SKILLS,
            **asking) -> DataFrame:
    """Stubs with the extraction's columns, by ``model`` or else by rules.

    ``asking`` goes to :func:`model_replies`. A row whose replies could not be used gets the empty
    extraction; to keep such rows out of a load, filter by :func:`unanswered` before
    :func:`check_replies`.
    """
    if model is not None or asking.get("load") is not None:
        return check_replies(model_replies(stubs, model, **asking))
    return _with_extraction(rule_extraction(stubs, skills))


def job_rows(extracted: DataFrame, source: str = K.DEFAULT_SOURCE) -> DataFrame:
    """Postings ready to load: stub columns, extraction and the constant source."""
    ready = extracted.withColumns({"source": F.lit(source),
                                   "posted_at": F.col("posted_at").cast("date")})
    order = [c for c in ("keyword_ord", "page", "position") if c in extracted.columns]
    return ready.select(*STAGED_COLUMNS, *order)
