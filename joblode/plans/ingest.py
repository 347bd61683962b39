"""The ingest run: harvest, extract, load postings, load vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblode import constants as K
from joblode.operators.aggregates import count_jobs_on
from joblode.operators.embed import Embedder
from joblode.operators.extract import SKILLS, extract, job_rows
from joblode.operators.harvest import (ARRIVAL, daily_quota, first_seen, page_rule, page_rule_in_turn,
                                       read_cards, read_details)
from joblode.operators.keys import BROADCAST_ROWS, first_by, fits_broadcast, rows_with_ids, unknown_rows
from joblode.operators.vectors import build_vectors, missing_vectors
from joblode.schemas import EXTRACTED_SCHEMA, STUB_SCHEMA
from joblode.session import scratch_scope, staged
from joblode.sources.stages import read_stage, stage_done, stage_path, write_stage
from joblode.sources.tables import (LoadCounts, insert_jobs, pending_vectors, read_jobs, read_vectors,
                                    upsert_vectors)


def new_stubs(pages: DataFrame, jobs: DataFrame, n_keywords: int | None = None, in_turn: bool = False) -> DataFrame:
    """Stubs on result pages whose job is not stored, one per job, by the page rule.

    Cards are counted against the stored ids alone, so keywords need not run one
    after the other; with ``in_turn`` against those of earlier keywords too. The
    narrow cards are written once: the page rule goes over them twice and would
    parse the pages again.
    """
    cards = staged(read_cards(pages), "cards")
    new = unknown_rows(cards, jobs, small_batch=fits_broadcast(cards))
    return first_seen((page_rule_in_turn if in_turn else page_rule)(new, n_keywords=n_keywords))


def harvest(pages: DataFrame, details: DataFrame, jobs: DataFrame, as_of: datetime,
            target: int = K.DAILY_TARGET, n_keywords: int | None = None, in_turn: bool = False) -> DataFrame:
    """Stubs with description and date, up to what the day's target leaves room for.

    ``pages`` are result pages with ``keyword, keyword_ord, page, html``,
    ``details`` posting pages with ``id, html``. The quota is applied to the
    narrow stubs before any posting page is read. A stub without a usable page
    stays, with the description "N/A".
    """
    done = count_jobs_on(jobs, as_of.date()).first()["n"]
    if done >= target:
        return pages.sparkSession.createDataFrame([], STUB_SCHEMA)
    kept = staged(daily_quota(new_stubs(pages, jobs, n_keywords, in_turn), done, target), "stubs")
    ids = kept.select("id")
    if target - done <= BROADCAST_ROWS:  # no more rows than the quota leaves
        ids = F.broadcast(ids)
    read = read_details(details.join(ids, "id", "left_semi"), as_of).withColumn(
        "posted_at", F.col("posted_at").cast("string"))
    # A posting page stored twice counts once, one with a description first.
    usable = (F.col("raw_description") == K.MISSING, F.col("posted_at").isNull(), *read.columns)
    read = first_by(read, ["id"], usable)
    return kept.join(read, "id", "left").select(*[
        (F.coalesce(n, F.lit(K.MISSING)) if n == "raw_description" else F.col(n)).alias(n)
        for n in STUB_SCHEMA.names])


def run_extract(stubs: DataFrame, model: Callable[[str, str], str] | None = None,
                source: str = K.DEFAULT_SOURCE, skills: Sequence[str] = SKILLS) -> DataFrame:
    return job_rows(extract(stubs, model, skills=skills), source)


def load_jobs(spark: SparkSession, path: str, rows: DataFrame, as_of: datetime) -> LoadCounts:
    arrival = [c for c in ARRIVAL if c in rows.columns]
    return insert_jobs(spark, path, rows, as_of=as_of, arrival=arrival)


def load_vectors(spark: SparkSession, jobs_path: str, vectors_path: str,
                 embedder: Embedder | None = None, *, ids: DataFrame | None = None) -> LoadCounts:
    """Build vectors for postings that have none; safe to repeat.

    ``ids``: the postings to look at, as those of one load; all without it.
    """
    jobs = read_jobs(spark, jobs_path)
    if ids is not None:
        jobs = rows_with_ids(jobs, F.broadcast(ids) if fits_broadcast(ids) else ids)
    missing = missing_vectors(jobs, read_vectors(spark, vectors_path))
    return upsert_vectors(spark, vectors_path, missing, build=lambda rows: build_vectors(rows, embedder))


def load_pending_vectors(spark: SparkSession, jobs_path: str, vectors_path: str,
                         embedder: Embedder | None = None) -> LoadCounts:
    """Build vectors for all postings that were logged as pending; safe to repeat.

    Only the days that pending postings were loaded on are read. A table with rows from before its log
    is compared whole, once.
    """
    with pending_vectors(spark, jobs_path) as pending:
        if pending is None:
            return load_vectors(spark, jobs_path, vectors_path, embedder)
        pending = staged(pending, "pending")
        days = [r["scraped_on"] for r in pending.select("scraped_on").distinct().collect()]
        ids = pending.select("id").distinct()
        jobs = read_jobs(spark, jobs_path).filter(F.col("scraped_on").isin(days))
        jobs = rows_with_ids(jobs, F.broadcast(ids) if fits_broadcast(ids) else ids)
        missing = missing_vectors(jobs, read_vectors(spark, vectors_path))
        return upsert_vectors(spark, vectors_path, missing, build=lambda rows: build_vectors(rows, embedder))


@dataclass(frozen=True)
class RunCounts:
    jobs: LoadCounts
    vectors: LoadCounts


def run_all(spark: SparkSession, pages: DataFrame, details: DataFrame, jobs_path: str,
            vectors_path: str, *, as_of: datetime | None = None,
            target: int = K.DAILY_TARGET, model: Callable[[str, str], str] | None = None,
            embedder: Embedder | None = None, n_keywords: int | None = None, in_turn: bool = False,
            stages: str | None = None, run_id: str = "run", skills: Sequence[str] = SKILLS) -> RunCounts:
    """All stages in order; scratch copies go when the run ends.

    With ``stages`` each stage hands over a file in that folder, named by ``run_id`` and the stage, and
    a stage whose file is complete is not done again.
    """
    as_of = as_of or datetime.now(timezone.utc).replace(tzinfo=None)

    def handed(name: str, schema: T.StructType, make: Callable[[], DataFrame]) -> DataFrame:
        if stages is None:
            return make()
        path = stage_path(stages, run_id, name)
        if not stage_done(spark, path):
            write_stage(make(), path)
        return read_stage(spark, path, schema)

    with scratch_scope(spark):
        stubs = handed("stubs", STUB_SCHEMA, lambda: harvest(
            pages, details, read_jobs(spark, jobs_path), as_of, target, n_keywords, in_turn))
        rows = handed("extracted", EXTRACTED_SCHEMA, lambda: run_extract(stubs, model, skills=skills))
        rows = staged(rows, "extracted")
        loaded = load_jobs(spark, jobs_path, rows, as_of)
        return RunCounts(loaded, load_vectors(spark, jobs_path, vectors_path, embedder, ids=rows.select("id")))
