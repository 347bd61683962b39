"""Exact deduplication by progressive refinement, in DataFrame operations only.

Texts are equal when they are identical once each run of white space is one
space. Rows are told apart by length, then by a hash of the first ``HEAD``
characters, and only rows that share both with another row are compared by the
hash of their full text. The keys are counted with partial aggregates, so a
group that holds a third of all rows costs one row per task; rows meet their
group's result in joins that Spark may split.

Defined results: a null text equals an empty one; of rows with equal texts and
equal ids exactly one is kept; a null id is larger than any other; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.llm.keep import kept_rows
from joblode.llm.registry import case, documents
from joblode.llm.tokens import narrow
from joblode.session import staged

HEAD = 256
# Keys of surviving groups, of 12 bytes each, that are sent to every task.
BROADCAST_KEYS = 1_000_000


def one_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", " ")


def _keys(docs: DataFrame) -> DataFrame:
    return (docs.select("doc_id", one_space(F.col("text")).alias("text"))
            .select("doc_id", "text", F.char_length("text").alias("chars"),
                    F.xxhash64(F.substring("text", 1, HEAD)).alias("head")))


def _crowded(keys: DataFrame) -> DataFrame:
    """(chars, head) that more than one row has."""
    return keys.groupBy("chars", "head").agg(F.count("*").alias("n")).filter("n > 1").select("chars", "head")


def exact_groups(docs: DataFrame, digest_all: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``.

    Only texts of surviving groups are read in full and hashed; a text that is alone has a null
    ``text_sha256``. With ``digest_all`` every text is hashed, in the first and then only reading.
    """
    docs = narrow(docs, id_col, text_col)
    full, row = F.sha2("text", 256).alias("full"), F.monotonically_increasing_id().alias("row")
    if digest_all:
        first = staged(_keys(docs).select("doc_id", "chars", "head", full, row), "exact-keys")
        marked = first.join(_crowded(first).withColumn("crowded", F.lit(True)), ["chars", "head"], "left")
        # Written, as later groupings would keep the join's partitions and with them its largest.
        marked = staged(marked, "exact-marked")
        alone, survivors = marked.filter("crowded IS NULL"), marked.filter("crowded")
    else:
        first = staged(_keys(docs).select("doc_id", "chars", "head"), "exact-keys")
        crowded = staged(_crowded(first), "exact-crowded")
        alone = first.join(crowded, ["chars", "head"], "left_anti").withColumn("full", F.lit(None).cast("string"))
        texts = _keys(docs)
        if crowded.count() <= BROADCAST_KEYS:  # the full text is hashed behind the join
            read = texts.join(F.broadcast(crowded), ["chars", "head"], "left_semi").select(
                "doc_id", "chars", "head", full)
        else:  # digests are shuffled, not texts
            read = texts.select("doc_id", "chars", "head", full).join(crowded, ["chars", "head"], "left_semi")
        survivors = staged(read.withColumn("row", F.monotonically_increasing_id()), "exact-survivors")
    first_of = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    groups = survivors.groupBy("chars", "head", "full").agg(first_of, F.count("*").alias("group_size"))
    grouped = survivors.join(groups, ["chars", "head", "full"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), F.col("full").alias("text_sha256"))
    return alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                        F.lit(True).alias("kept"), F.col("full").alias("text_sha256")).unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns."""
    groups = exact_groups(docs, digest_all=True, id_col=id_col, text_col=text_col)
    key = F.sha2(one_space(F.col(text_col).cast("string")), 256)
    return kept_rows(docs, groups.withColumnRenamed("text_sha256", "key"), key, id_col)


OP1_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""


@case("op1_exact_dedup", OP1_SQL)
def op1(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir), digest_all=True)
