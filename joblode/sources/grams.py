"""Trigrams of postings by file, so that a substring search reads only files that may hold a match.

Beside the postings table lies a Parquet table of (column, gram, file): the distinct runs of three
characters of the lower-cased values in each file, so its size follows the alphabet and the number of
files, not the postings. A pattern's literal runs name the trigrams that a file must hold. The pattern
itself is tested on the rows after, so results are those of the whole scan. Files that are not indexed
yet are always read; files of postings are never changed, so an entry stays true.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode.operators.criteria import like_pattern
from joblode.session import file_at, stage

SEARCHED = ("role", "location", "company", "title")
GRAM = 3
# A file of postings within its table: its day's folder and its name.
_WITHIN = r"([^/]+/[^/]+)$"


def _grams_path(path: str) -> str:
    return f"{path.rstrip('/')}-grams"


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Folders of whole refreshes; one that stopped half-way has no list of files."""
    files, place = file_at(spark, _grams_path(path))
    names = [f.getPath().toString() for f in files.listStatus(place)] if files.exists(place) else []
    return [n for n in sorted(names) if files.exists(file_at(spark, f"{n}/files/_SUCCESS")[1])]


def _indexed(spark: SparkSession, path: str) -> set[str]:
    parts = [f"{p}/files" for p in _parts(spark, path)]
    return {r["file"] for r in spark.read.schema("file string").parquet(*parts).collect()} if parts else set()


def _stored(jobs: DataFrame) -> set[str]:
    return {re.search(_WITHIN, name)[1] for name in jobs.inputFiles()}


def _read(jobs: DataFrame, path: str, files: Sequence[str]) -> DataFrame:
    """The postings of some files of a table."""
    return jobs.sparkSession.read.schema(jobs.schema).option("basePath", path).parquet(
        *[f"{path.rstrip('/')}/{f}" for f in sorted(files)])


def refresh_grams(spark: SparkSession, path: str, jobs: DataFrame) -> int:
    """Indexes the files of a postings table that are not indexed yet; their number.

    ``jobs`` is the whole table at ``path``. Null and shorter values have no trigrams.
    """
    new = _stored(jobs) - _indexed(spark, path)
    if not new:
        return 0
    values = _read(jobs, path, new).select(
        F.regexp_extract("_metadata.file_path", _WITHIN, 1).alias("file"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lower(c).alias("text")) for c in SEARCHED])))
    # A value stands once for each file and task before it is cut.
    texts = values.select("file", "col.column", "col.text").filter(F.char_length("text") >= GRAM).distinct()
    starts = F.sequence(F.lit(1), F.char_length("text") - (GRAM - 1))
    grams = texts.select("column", "file", F.explode(F.transform(
        starts, lambda i: F.substring("text", i, F.lit(GRAM)))).alias("gram")).distinct()
    at = f"{_grams_path(path)}/{uuid.uuid4().hex}"
    with stage(grams, "grams") as cut:
        # Sorted, so that a search for a few trigrams skips the other row groups.
        cut.repartitionByRange("column", "gram", "file").sortWithinPartitions("column", "gram").write.parquet(
            f"{at}/grams")
    spark.createDataFrame([(f,) for f in sorted(new)], "file string").coalesce(1).write.parquet(f"{at}/files")
    return len(new)


def literal_grams(text: str) -> set[str]:
    """The trigrams that a value holds if ``text`` stands in it, in the sense of :func:`like_anywhere`."""
    runs = [""]
    for mark, char in re.findall(r"(\\?)(.)", like_pattern(text), flags=re.S):
        if char in "%_" and not mark:
            runs.append("")
        else:
            runs[-1] += char
    return {run[i:i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)}


def read_jobs_like(spark: SparkSession, path: str, jobs: DataFrame, **patterns: str | Sequence[str] | None) -> DataFrame:
    """The postings of files in which every named column may hold its pattern, or one of its patterns.

    The rows are still to be filtered. A column without a pattern, and a pattern without three literal
    characters in a row, rule no file out. The driver sees names of files, as every scan's does.
    """
    asked = {column: [literal_grams(t) for t in ([texts] if isinstance(texts, str) else texts)]
             for column, texts in patterns.items() if texts}
    if not asked.keys() <= set(SEARCHED):
        raise ValueError(f"no trigrams of {', '.join(sorted(asked.keys() - set(SEARCHED)))}")
    asked = {column: choices for column, choices in asked.items() if all(choices)}
    parts = _parts(spark, path)
    if not asked or not parts:
        return jobs
    held = spark.read.schema("column string, file string, gram string").parquet(*[f"{p}/grams" for p in parts])
    wanted = {c: sorted(set().union(*choices)) for c, choices in asked.items()}
    meets, named = F.lit(True), F.lit(False)
    for column, choices in asked.items():
        one = F.lit(False)
        for grams in choices:
            needed = F.array(*[F.lit(f"{column}:{g}") for g in sorted(grams)])
            one = one | (F.size(F.array_except(needed, F.col("have"))) == 0)
        meets = meets & one
        named = named | ((F.col("column") == column) & F.col("gram").isin(wanted[column]))
    have = held.filter(named).groupBy("file").agg(
        F.collect_set(F.concat_ws(":", "column", "gram")).alias("have"))  # at most the patterns' trigrams
    stored = _stored(jobs)
    files = stored - _indexed(spark, path) | stored & {r["file"] for r in have.filter(meets).select("file").collect()}
    return jobs if files == stored else _read(jobs, path, files) if files else jobs.limit(0)
