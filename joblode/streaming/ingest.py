"""Streams of postings into the same tables.

Batches go through the batch sinks. A batch that is delivered twice finds its ids
stored and adds nothing, so the tables hold each posting once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from joblode.operators.aggregates import count_jobs_on
from joblode.operators.embed import Embedder
from joblode.operators.keys import fits_broadcast, take_first
from joblode.plans.ingest import load_pending_vectors
from joblode.session import scratch_scope, stage, staged
from joblode.sources.tables import insert_jobs, new_jobs, read_jobs


def ingest_stream(stream: DataFrame, jobs_path: str, checkpoint: str, *,
                  as_of: Callable[[], datetime], arrival: Sequence[str] = (),
                  daily_target: int | None = None, vectors_path: str | None = None,
                  embedder: Embedder | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Insert a stream of postings; known ids are skipped.

    ``daily_target`` caps what is added per day, in order of ``arrival``. With
    ``vectors_path`` the vectors of all postings that have none are built after each batch:
    of its own, and of those that earlier batches loaded without vectors or before a failure.
    """
    def load(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        now = as_of()
        with scratch_scope(spark), stage(batch, "batch") as rows:
            if daily_target is None:
                insert_jobs(spark, jobs_path, rows, as_of=now, arrival=arrival, pending=True)
            else:
                jobs = read_jobs(spark, jobs_path)
                done = count_jobs_on(jobs, now.date()).first()["n"]
                # Reduced to new ids first, so that a repeated batch uses no room.
                fresh = staged(new_jobs(rows, jobs, arrival, small_batch=fits_broadcast(rows)), "quota")
                room = take_first(fresh, (*arrival, "id"), daily_target - done)
                insert_jobs(spark, jobs_path, room, as_of=now, arrival=arrival, pending=True)
            if vectors_path is not None:
                load_pending_vectors(spark, jobs_path, vectors_path, embedder)

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def distinct_stream(stream: DataFrame, time_col: str, delay: str = "1 day") -> DataFrame:
    """First arrival of each id, with state kept for ``delay`` of event time only."""
    if isinstance(stream.schema[time_col].dataType, TimestampNTZType):
        stream = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["id"])
