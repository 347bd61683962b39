"""The postings table and the vector table, as Parquet folders or over JDBC.

Postings are laid out by load day, so a day's count reads one folder. Vectors are
laid out by a hash of the job id, so an upsert rewrites only the folders in which
a vector is replaced. Sinks are at-least-once safe: a repeated batch adds nothing.

An upsert writes folders of a version of its own and then, in one rename, the manifest
that names the folders of the table. Whoever reads sees the state of one manifest, and
an upsert that stops half-way leaves the state before it.

Postings whose vectors are not built yet can be kept in a log beside the table
(``pending``), so that building them later looks at those alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblode import constants as K
from joblode.functions.dates import moment
from joblode.operators.ann import Planes, cell_of, layout_of
from joblode.operators.keys import first_by, first_rows, fits_broadcast, unknown_rows
from joblode.schemas import JOBS_SCHEMA, VECTOR_SCHEMA
from joblode.session import stage, staged
from joblode.sources.idindex import add_to_index, index_buckets, stored_among

_JOBS_LAYOUT = T.StructType([*JOBS_SCHEMA.fields, T.StructField("scraped_on", T.DateType())])
_VECTOR_LAYOUT = T.StructType([*VECTOR_SCHEMA.fields, T.StructField("layout", T.StringType()),
                               T.StructField("bucket", T.IntegerType())])

# The most vectors of a posting: the whole and its fields.
PARTS = 1 + len(K.FIELD_VECTORS)
# Vectors of a new table's first load for each of its folders, and the least number of folders.
BUCKET_VECTORS = 250_000
VECTOR_BUCKETS = 64
# Stands for the folder of vectors that have no cell.
NO_CELL = -1
# Spark's name of the folder of a null.
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
# Versions whose folders stay for those who read them still; older ones go with the next upsert.
KEPT_VERSIONS = 2
# In the log of postings without vectors: the table has rows from before the log.
_UNLOGGED = "unlogged"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str] | None:
    """What a folder holds; None if there is none."""
    files, place = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else None


def _read(spark: SparkSession, path: str, layout: T.StructType) -> DataFrame:
    files, place = _files(spark, path)
    if not files.exists(place):
        return spark.createDataFrame([], layout)
    return spark.read.schema(layout).parquet(path)


# -- postings -----------------------------------------------------------------

def insert_into_catalog(spark: SparkSession, name: str, incoming: DataFrame, *,
                        as_of: datetime | str | Column, arrival: Sequence[str] = ()) -> LoadCounts:
    """:func:`insert_jobs` into a table of :func:`create_jobs_table`; new days become visible to it."""
    rows = spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").collect()
    counts = insert_jobs(spark, rows[0]["data_type"], incoming, as_of=as_of, arrival=arrival)
    spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return counts


def create_jobs_table(spark: SparkSession, name: str, path: str | None = None) -> None:
    """A catalog table for postings, if it does not exist."""
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_ddl(_JOBS_LAYOUT)}) USING parquet "
              f"PARTITIONED BY (scraped_on){place}")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The postings; empty if nothing was loaded yet.

    Also holds ``scraped_on``, the folder column that day filters prune by.
    """
    return _read(spark, path, _JOBS_LAYOUT)


def read_jobs_jdbc(spark: SparkSession, url: str, table: str = "jobs", *,
                   bounds: tuple[str, str] | None = None, partitions: int = 64,
                   **options: str) -> DataFrame:
    """The same table in a relational database; needs its driver on the class path.

    With ``bounds`` on ``scraped_at`` the table is read in parallel ranges.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if bounds:
        reader = reader.options(partitionColumn="scraped_at", lowerBound=bounds[0],
                                upperBound=bounds[1], numPartitions=str(partitions))
    return reader.options(**options).load()


@dataclass(frozen=True)
class LoadCounts:
    """Rows handed to a sink, and rows that were new to it."""

    sent: int
    inserted: int


def conform_jobs(incoming: DataFrame, as_of: datetime | str | Column,
                 keep: Sequence[str] = ()) -> DataFrame:
    """``incoming`` with all columns of the table; absent ones get their defaults.

    Columns named in ``keep`` stay as they are.
    """
    def column(field: T.StructField) -> Column:
        value = (F.col(field.name) if field.name in incoming.columns
                 else F.lit(None)).cast(field.dataType)
        if field.name == "source":
            value = F.coalesce(value, F.lit(K.DEFAULT_SOURCE))
        if field.name == "scraped_at":
            value = F.coalesce(value, moment(as_of))
        return value.alias(field.name)

    return incoming.select(*[column(f) for f in JOBS_SCHEMA],
                           *[c for c in keep if c not in JOBS_SCHEMA.names])


def new_jobs(incoming: DataFrame, jobs: DataFrame, arrival: Sequence[str] = (), *,
             small_batch: bool = False, written: bool = False) -> DataFrame:
    """Incoming rows to insert: the first of each id by ``arrival``, unless the id is stored.

    Rows without an id are not kept. Rows that arrived together are told apart by all their columns,
    so that a repeat keeps the same one. Of a batch that was ``written`` before, ids alone meet each other
    and the stored ones; its rows stay where they are unless their id comes again.
    """
    keyed = incoming.filter(F.col("id").isNotNull())
    order = [*arrival, *[c for c in keyed.columns if c not in ("id", *arrival)]]
    if not written:
        return unknown_rows(first_by(keyed, ["id"], order), jobs, small_batch=small_batch)
    ids = keyed.select("id")
    known = staged(jobs.select("id").join(F.broadcast(ids) if small_batch else ids, "id", "left_semi").distinct(), "known-ids")
    return first_rows(keyed, order).join(F.broadcast(known) if fits_broadcast(known) else known, "id", "left_anti")


def insert_jobs(spark: SparkSession, path: str, incoming: DataFrame, *,
                as_of: datetime | str | Column, arrival: Sequence[str] = (), pending: bool = False,
                by_index: bool | None = None) -> LoadCounts:
    """Append postings whose id is not stored yet.

    The batch is staged first, so that extraction and load time are computed
    once and a repeat after a failure sees the same rows. ``pending`` logs the batch's ids
    before, for :func:`pending_vectors`. If the table has an index of its ids
    (:func:`joblode.sources.idindex.build_index`), a batch too large to broadcast (any batch, with
    ``by_index``) reads only the folders that may hold one of its ids, and new rows are indexed
    before they are appended.
    """
    with ExitStack() as steps:
        batch = steps.enter_context(stage(conform_jobs(incoming, as_of, arrival), "jobs"))
        if pending:
            _log_pending(spark, path, batch)
        stored, small = read_jobs(spark, path), fits_broadcast(batch)
        indexed = index_buckets(spark, path) is not None
        if indexed and (by_index or by_index is None and not small):
            stored = steps.enter_context(stored_among(spark, path, batch, stored))
        fresh = new_jobs(batch, stored, arrival, small_batch=small, written=True).select(
            *JOBS_SCHEMA.names, F.to_date("scraped_at").alias("scraped_on"))
        if indexed:
            fresh = steps.enter_context(stage(fresh, "fresh"))
            add_to_index(spark, path, fresh)
        seen = Observation()
        rows = fresh.hint("rebalance", "scraped_on").observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("append").partitionBy("scraped_on").parquet(path)
        return LoadCounts(sent=batch.count(), inserted=seen.get["n"])


# -- postings without vectors ---------------------------------------------------

def _pending_path(path: str) -> str:
    return f"{path.rstrip('/')}-pending"


def _log_pending(spark: SparkSession, path: str, batch: DataFrame) -> None:
    """Logs the ids of a batch with the day that it loads them on, before the batch is inserted.

    An id that is stored already is logged too: whether it lacks vectors is asked when they are built.
    """
    log = _pending_path(path)
    if _names(spark, log) is None and _names(spark, path) is not None:
        files, place = _files(spark, f"{log}/{_UNLOGGED}")
        files.mkdirs(place)
    rows = batch.filter(F.col("id").isNotNull()).select("id", F.to_date("scraped_at").alias("scraped_on")).distinct()
    rows.write.parquet(f"{log}/{uuid.uuid4().hex}")


@contextmanager
def pending_vectors(spark: SparkSession, path: str) -> Iterator[DataFrame | None]:
    """(id, scraped_on) of the postings logged so far; None if rows of the table were not logged.

    What was logged when the block began is struck off when it ends without an error, so a block
    that fails is given the same rows again. An id that was logged but not inserted is not in the table.
    """
    log = _pending_path(path)
    names = _names(spark, log)
    known = names is not None and _UNLOGGED not in names
    done = [f"{log}/{n}" for n in names or ()]
    if not known:
        yield None
    elif not done:
        yield spark.createDataFrame([], "id string, scraped_on date")
    else:
        yield spark.read.schema("id string, scraped_on date").parquet(*done).distinct()
    for folder in done:
        files, place = _files(spark, folder)
        files.delete(place, True)
    files, place = _files(spark, log)
    files.mkdirs(place)  # from now on the log is whole


# -- vectors ------------------------------------------------------------------

def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, list[str]]]:
    """The newest version, 0 if there is none, and its folders: the versions that each folder's rows stand in."""
    names = [int(n.split(".")[0]) for n in _names(spark, f"{path}/manifests") or () if n.endswith(".json")]
    if not names:
        return 0, {}
    files, place = _files(spark, f"{path}/manifests/{max(names)}.json")
    source = files.open(place)
    try:
        return max(names), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def _commit(spark: SparkSession, path: str, number: int, folders: dict[str, list[str]]) -> None:
    """Makes ``folders`` the table, in one rename; an error if another upsert came first."""
    files, draft = _files(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = files.create(draft)
    try:
        out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
    finally:
        out.close()
    _, place = _files(spark, f"{path}/manifests/{number}.json")
    if files.exists(place) or not files.rename(draft, place):
        files.delete(draft, False)
        raise RuntimeError(f"version {number} of {path} was written by another upsert")


def _drop_old(spark: SparkSession, path: str, number: int) -> None:
    """Removes manifests before the kept ones, and versions that none of those names; so also those of failed upserts."""
    keep: set[str] = set()
    for name in _names(spark, f"{path}/manifests") or ():
        files, place = _files(spark, f"{path}/manifests/{name}")
        if not name.endswith(".json"):
            continue
        if int(name.split(".")[0]) <= number - KEPT_VERSIONS:
            files.delete(place, False)
            continue
        source = files.open(place)
        try:
            keep.update(v for held in json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")).values() for v in held)
        finally:
            source.close()
    for name in _names(spark, f"{path}/data") or ():
        if name.removeprefix("version=") not in keep:
            files, place = _files(spark, f"{path}/data/{name}")
            files.delete(place, True)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vector table in its newest version; empty if it does not exist. Similarity is cosine."""
    _, folders = _manifest(spark, path)
    places = [f"{path}/data/version={v}/{folder}" for folder, held in folders.items() for v in held]
    if not places:
        return spark.createDataFrame([], _VECTOR_LAYOUT)
    return (spark.read.schema(T.StructType([*_VECTOR_LAYOUT.fields, T.StructField("version", T.StringType())]))
            .option("basePath", f"{path}/data").parquet(*places).drop("version"))


def vector_ids(vectors: DataFrame) -> DataFrame:
    """All vector ids, from a scan of that column."""
    return vectors.select("vector_id")


def job_ids(jobs: DataFrame) -> DataFrame:
    return jobs.select("id")


def _layout(stored: DataFrame, kind: str, asked: int | None, rows: int) -> str:
    """The table's own layout, or one for a table that begins with ``rows`` vectors."""
    known = stored.select("layout").limit(1).first()
    if known is None:
        return f"{kind}-{asked or max(VECTOR_BUCKETS, -(-rows // BUCKET_VECTORS))}"
    own_kind, number = known["layout"].split("-")
    if own_kind != kind or asked not in (None, int(number)):
        raise ValueError(f"the table is laid out by {known['layout']}")
    return known["layout"]


def _version(number: int) -> str:
    return f"{number}-{uuid.uuid4().hex[:8]}"


def _written(spark: SparkSession, path: str, layout: str, version: str) -> list[str]:
    """The folders that a version has."""
    return [f"layout={layout}/{folder}" for folder in _names(spark, f"{path}/data/version={version}/layout={layout}") or ()]


def _build_vectors(spark: SparkSession, path: str, jobs: DataFrame,
                   build: Callable[[DataFrame], DataFrame]) -> LoadCounts:
    """:func:`upsert_vectors` with ``build``: no copy of the vectors is made or shuffled."""
    number, folders = _manifest(spark, path)
    stored = read_vectors(spark, path)
    layout = _layout(stored, "hash", None, 0 if folders else PARTS * jobs.select("id").count())
    buckets = int(layout.split("-")[1])
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")
    seen, version = Observation(), _version(number + 1)
    dealt = jobs.withColumn("_bucket", place("id")).hint("rebalance", "_bucket").drop("_bucket")
    rows = build(dealt).select(*VECTOR_SCHEMA.names).withColumns({"layout": F.lit(layout), "bucket": place("job_id")})
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("layout", "bucket").parquet(f"{path}/data/version={version}")
    sent, fresh = seen.get["n"], _written(spark, path, layout, version)
    table, replaced = dict(folders), 0
    if folders and fresh:
        new = (spark.read.schema(_VECTOR_LAYOUT).parquet(f"{path}/data/version={version}").select("vector_id"))
        ids = F.broadcast(new) if fits_broadcast(new, "vector_id") else new
        clash = stored.select("vector_id", "bucket").join(ids, "vector_id", "left_semi")
        # One row per folder at most.
        touched = {r["bucket"]: r["n"] for r in clash.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        replaced = sum(touched.values())
        if touched:
            # What else the folders of replaced vectors hold stands in a version beside.
            others = _version(number + 1)
            stored.filter(F.col("bucket").isin(list(touched))).join(ids, "vector_id", "left_anti").hint(
                "rebalance", "bucket").write.partitionBy("layout", "bucket").parquet(f"{path}/data/version={others}")
            table = {f: held for f, held in folders.items() if int(f.rpartition("=")[2]) not in touched}
            for folder in _written(spark, path, layout, others):
                table[folder] = [others]
    for folder in fresh:
        table[folder] = [*table.get(folder, ()), version]
    _commit(spark, path, number + 1, table)
    _drop_old(spark, path, number + 1)
    return LoadCounts(sent=sent, inserted=sent - replaced)


def upsert_vectors(spark: SparkSession, path: str, rows: DataFrame, *, buckets: int | None = None,
                   unique: bool = False, arrival: Sequence[str] = (), planes: Planes | None = None,
                   build: Callable[[DataFrame], DataFrame] | None = None) -> LoadCounts:
    """Write vectors by id; a vector that is stored already is replaced.

    Pass ``unique`` if ``rows`` holds each vector id once, as the vectors of
    distinct postings do; otherwise the last row of each id by ``arrival`` is
    kept, and of rows that arrived together the first by document and embedding.
    Folders are hashes of the job id or, with ``planes`` (hyperplanes or trained
    cells), cells that a search can be pruned to. Their number is chosen at the first load, by its size unless
    ``buckets`` names it, and kept in the table's layout; another layout later is
    an error. Folders in which a vector is replaced are written anew with what else
    they hold; to others the new rows are added. The table is the old one until the
    version's manifest stands.

    With ``build`` the rows are postings of distinct ids and ``build`` makes vectors of them, at most ``PARTS``
    of each: postings are dealt out to the folders, and each one's vectors are built where they are written.
    """
    if build is not None:
        if planes is not None or buckets is not None:
            raise ValueError("vectors built in place are laid out by job id, in as many folders as their number asks for")
        return _build_vectors(spark, path, rows, build)
    if not unique:
        rows = first_by(rows, ["vector_id"], [*[F.desc_nulls_last(a) for a in arrival], "document", "embedding"])
    with stage(rows.select(*VECTOR_SCHEMA.names), "vectors") as staged_rows:
        stored, sent = read_vectors(spark, path), staged_rows.count()
        layout = (_layout(stored, "hash", buckets, sent) if planes is None else
                  _layout(stored, *layout_of(planes), sent))
        hashed = F.pmod(F.xxhash64("job_id"), F.lit(int(layout.split("-")[1]))).cast("int")
        place = ["layout", "bucket"]
        batch = staged_rows.withColumns({
            "layout": F.lit(layout), "bucket": hashed if planes is None else cell_of("embedding", planes)})
        ids = batch.select("vector_id")
        if fits_broadcast(ids, "vector_id"):
            ids = F.broadcast(ids)
        clash = stored.select("vector_id", "bucket").join(ids, "vector_id", "left_semi")
        # One row per folder at most.
        touched = {NO_CELL if r["bucket"] is None else r["bucket"]: r["n"] for r in
                   clash.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = batch
        if touched:
            # A replaced vector may have moved to another cell; one without an embedding has none.
            hit = F.array_contains(F.array(*map(F.lit, touched)), F.coalesce("bucket", F.lit(NO_CELL)))
            rows = batch.unionByName(stored.filter(hit).join(ids, "vector_id", "left_anti"))
        number, folders = _manifest(spark, path)
        version = f"{number + 1}-{uuid.uuid4().hex[:8]}"
        at = f"{path}/data/version={version}"
        rows.hint("rebalance", "bucket").write.partitionBy(*place).parquet(at)
        named = lambda b: f"layout={layout}/bucket={_NULL_FOLDER if b == NO_CELL else b}"
        replaced = set(map(named, touched))
        # A replaced folder whose vectors have all moved away is no longer named.
        table = {f: held for f, held in folders.items() if f not in replaced}
        for folder in _names(spark, f"{at}/layout={layout}") or ():
            folder = f"layout={layout}/{folder}"
            table[folder] = [*table.get(folder, ()), version]
        _commit(spark, path, number + 1, table)
    _drop_old(spark, path, number + 1)
    return LoadCounts(sent=sent, inserted=sent - sum(touched.values()))
