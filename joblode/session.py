"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

# Paths made since a scope began, by scope.
_SCOPES: list[list[str]] = []

# Left to AQE at scale: the partition count is only a starting point that is
# coalesced (or split, for skewed joins) from the sizes seen at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # Call sites of column expressions are not recorded: plans are built faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName("joblode")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else one beside the warehouse's tables.

    On a cluster a warehouse on the driver's own disk is refused: executors would not find its files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and (urlsplit(warehouse).scheme or "file") == "file":
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors see; {warehouse} is local")
    return f"{warehouse.rstrip('/')}/_scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/joblode/{name}-{uuid.uuid4().hex}"
    files, place = file_at(spark, path)
    files.deleteOnExit(place)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch copies made inside once it ends; for runs that end in a sink."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    files, place = file_at(spark, path)
    files.delete(place, True)


def file_at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage and computes ``df`` once, so that a lost executor re-reads
    rows instead of calling a user's model again, and later steps may prune
    columns of the written table. The copy goes when the driver ends.
    """
    return _write_and_read(df, scratch(df.sparkSession, name))


@contextmanager
def stage(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """Like :func:`staged`, for a sink: the copy is removed once the sink is done."""
    path = scratch(df.sparkSession, name)
    try:
        yield _write_and_read(df, path)
    finally:
        remove(df.sparkSession, path)


def _write_and_read(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt out to all cores, if the scan alone would leave cores idle.

    For costly per-row work over a few large files. A table of many files has
    more partitions than the cluster has cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
