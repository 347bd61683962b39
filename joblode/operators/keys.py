"""Keyed set operations: first row of a key, known keys, and ordered cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblode.session import staged

# Ids up to this many rows and bytes are broadcast; beyond it both sides shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20

# A sorted cut up to this many rows is taken as a top-n in one step.
TOP_ROWS = 100_000


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key.

    Written as a rank-1 filter, for which Spark puts a group limit before the
    shuffle: each task passes on one row per key, so a key that holds a third of
    the table costs no more than any other.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


def fits_broadcast(ids: DataFrame, id_col: str = "id") -> bool:
    """Whether a column of ids is small enough to broadcast, by count and bytes."""
    rows, size = ids.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(id_col).cast("string")))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def first_rows(df: DataFrame, order: Sequence[str | Column], id_col: str = "id") -> DataFrame:
    """The first row of every id, for wide rows: ids alone are counted, and only rows whose id comes again are ranked.

    More of such ids than can be broadcast: all rows are ranked. A null id is an id of its own.
    """
    again = staged(df.groupBy(id_col).agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select(
        F.col(id_col).alias("_again")), "repeated-ids")
    if not fits_broadcast(again, "_again"):
        return first_by(df, [id_col], order)
    same = df[id_col].eqNullSafe(again["_again"])
    return df.join(F.broadcast(again), same, "left_anti").unionByName(
        first_by(df.join(F.broadcast(again), same, "left_semi"), [id_col], order))


def unknown_rows(batch: DataFrame, known: DataFrame, id_col: str = "id", *,
                 small_batch: bool = False) -> DataFrame:
    """Rows of ``batch`` whose id is not among ``known``.

    With ``small_batch`` (checked by the caller) the batch's ids are broadcast to
    the big table's scan first, so that only the ids in common are left to
    anti-join and the big table is not shuffled.
    """
    known = known.select(id_col)
    if small_batch:
        known = known.join(F.broadcast(batch.select(id_col)), id_col, "left_semi")
    return batch.join(known, id_col, "left_anti")


def rows_with_ids(df: DataFrame, ids: DataFrame | Sequence[str], id_col: str = "id") -> DataFrame:
    """Rows whose id is asked for; unknown ids are dropped, order is not kept."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")
    return df.filter(F.col(id_col).isin(list(ids)))


def take_first(df: DataFrame, order: Sequence[str], n: int, *,
               top_rows: int | None = None) -> DataFrame:
    """The first ``n`` rows by ``order``, which must end in a unique column.

    A small ``n`` is a top-n. A large one would bring ``n`` rows to one task, so
    the rows are range-partitioned by ``order`` and written with the number of
    their partition: whole partitions are kept up to the one that holds the cut,
    and only that one is sorted. The driver sees one count per partition.
    """
    if n <= 0:
        return df.limit(0)
    if n <= (TOP_ROWS if top_rows is None else top_rows):
        return df.orderBy(*order).limit(n)
    ranged = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()),
                    "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    before = 0
    for part in sizes:
        if before + part["n"] >= n:
            cut = ranged.filter(F.col("_part") == part["_part"]).orderBy(*order).limit(n - before)
            return ranged.filter(F.col("_part") < part["_part"]).unionByName(cut).drop("_part")
        before += part["n"]
    return ranged.drop("_part")
