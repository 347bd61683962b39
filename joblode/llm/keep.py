"""Rows of documents by decisions that were made on their ids and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblode.session import staged


def kept_rows(docs: DataFrame, decided: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``decided`` keeps, with all their columns.

    ``decided``: (doc_id, key, kept), one row per row of ``docs``; ``key`` computes the same from ``docs``.
    Only ids of dropped rows meet whole rows. Where an id stands on several rows, they are told apart by
    the key; of rows equal in both, one stays: the first by all its columns that can be ordered.
    """
    decided = staged(decided.select("doc_id", "key", "kept"), "decided")
    repeated = staged(decided.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    dropped = decided.filter("NOT kept").select("doc_id").unionByName(repeated).select(F.col("doc_id").alias("_dropped"))
    # Whole rows travel as structs, so that their columns may have any name.
    own = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), key.alias("_key"))
    single = own.join(dropped, F.col("_id").eqNullSafe(F.col("_dropped")), "left_anti").select("_row.*")
    if repeated.isEmpty():
        return single
    twice = repeated.select(F.col("doc_id").alias("_r"))
    wanted = decided.filter("kept").join(twice, F.col("doc_id").eqNullSafe(F.col("_r")), "left_semi").select(
        F.col("doc_id").alias("_k"), F.col("key").alias("_h")).distinct()
    orderable = [F.col(f"_row.`{c}`") for c, t in docs.dtypes if not t.startswith(("map", "variant", "array", "struct"))]
    first = Window.partitionBy("_id", "_key").orderBy(*orderable)
    several = (own.join(wanted, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_key") == F.col("_h")), "left_semi")
               .withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_row.*"))
    return single.unionByName(several)
