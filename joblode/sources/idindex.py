"""An index of stored postings by id, for batches too large to broadcast.

Beside the postings table lies a Parquet table of (hash of the id, load day) in Spark buckets by the
hash. A batch's ids are joined to it: the batch alone is shuffled, the index is read bucket by bucket.
The days that come out are the only folders of postings to be read, and there the ids themselves are
compared, so ids of equal hash are told apart.

The index may name postings that were never stored (rows are indexed before they are appended), but
it never lacks one: once it is there, every load adds to it. One load at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode.operators.keys import fits_broadcast
from joblode.session import file_at, remove, stage

# Ids of a table for each bucket when its index is built, and the least number of buckets.
BUCKET_IDS = 5_000_000
LEAST_BUCKETS = 64


def _index_path(path: str) -> str:
    return f"{path.rstrip('/')}-ids"


def index_buckets(spark: SparkSession, path: str) -> int | None:
    """The number of buckets of the index of a table; None if it has no whole index."""
    files, place = file_at(spark, _index_path(path))
    for found in files.listStatus(place) if files.exists(place) else ():
        name = found.getPath().getName()
        if files.exists(file_at(spark, f"{_index_path(path)}/{name}/_SUCCESS")[1]):
            return int(name.removeprefix("buckets-"))
    return None


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    """The name of the index in this session's catalog, which is told of its buckets if need be."""
    files, place = file_at(spark, f"{_index_path(path)}/buckets-{buckets}")
    where = files.makeQualified(place).toString()
    name = f"joblode_ids_{hashlib.sha256(where.encode()).hexdigest()[:24]}"
    quoted = where.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (hash BIGINT, scraped_on DATE) USING parquet "
              f"CLUSTERED BY (hash) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    return name


def _write(spark: SparkSession, path: str, buckets: int, rows: DataFrame) -> None:
    hashed = rows.filter(F.col("id").isNotNull()).select(F.xxhash64("id").alias("hash"), "scraped_on")
    # One file for each bucket, not one for each task and bucket.
    hashed.repartition(buckets, "hash").write.insertInto(_table(spark, path, buckets))


def build_index(spark: SparkSession, path: str, stored: DataFrame, *, buckets: int | None = None) -> None:
    """Indexes a table's postings; nothing is done if they are indexed already.

    ``buckets`` is chosen by the number of postings unless named; at most two buckets' worth of
    ids to a core is a good choice for a table that will grow. An index left half-built is built anew.
    """
    if index_buckets(spark, path) is not None:
        return
    remove(spark, _index_path(path))
    _write(spark, path, buckets or max(LEAST_BUCKETS, -(-stored.count() // BUCKET_IDS)), stored)


def add_to_index(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Indexes postings (id, scraped_on) that are about to be appended."""
    _write(spark, path, index_buckets(spark, path), rows)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(hash, scraped_on) of the index."""
    return spark.table(_table(spark, path, index_buckets(spark, path)))


def found_days(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(id, scraped_on): the days on which a posting of that id may be stored. Null ids have none."""
    wanted = ids.filter(F.col("id").isNotNull()).select("id").distinct().withColumn("hash", F.xxhash64("id"))
    return wanted.join(read_index(spark, path), "hash").select("id", "scraped_on")


@contextmanager
def stored_among(spark: SparkSession, path: str, ids: DataFrame, stored: DataFrame) -> Iterator[DataFrame]:
    """Ids of ``stored`` that are among ``ids``; folders of days on which none of them may lie are not read."""
    with stage(found_days(spark, path, ids), "days") as found:
        # One value per folder at most.
        days = [r["scraped_on"] for r in found.select("scraped_on").distinct().collect()]
        named = F.col("scraped_on").isin([d for d in days if d is not None])
        if None in days:
            named = named | F.col("scraped_on").isNull()
        some = found.select("id")
        if fits_broadcast(some):
            some = F.broadcast(some)
        yield stored.filter(named).select("id").join(some, "id", "left_semi")
