"""Filter interaction audit: what each filter removes, in every order of the filters.

Each document fails or passes every filter. Per part, the documents (and those of
good quality, and toxic ones) are counted by their pattern of failures: a tensor
with one axis of length 2 (pass, fail) per filter. All that is asked about a step
of an order is a contraction of that tensor: a filter that stood before the step
selects "pass", the step's own "fail", a later one "all".

Spark does the counting: narrow rows are summed by (id, text), then by text, so a
text or an id that a third of all rows share is summed before it meets anything.
A part is then one row of at most 2^filters counts, and parts are contracted in
batches with einsum.

The filter on repeats asks whether a smaller id has the same text anywhere in the
table. Texts are held equal by SHA-256.

Defined results: a null text counts as empty, a null part as the empty string; a
null id is never larger than another, so its row does not fail the filter on
repeats, and has no labels; rows that share id and text are documents of their
own, none a repeat of the other; of several labels of one id, one that is 1
counts; null labels count as 0; an empty table gives no rows; other columns of
any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.llm.registry import case, documents
from joblode.session import staged

FILTERS = "ABCDE"
REPEATS = "E"
# Selectors of an axis.
PASS, FAIL, ALL = 0, 1, 2
VECTORS = np.array([[1, 0], [0, 1], [1, 1]], "int64")
# Parts that one contraction takes.
STEP = 64


def conditions(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that the text alone decides."""
    return {"A": F.size(words) < 200,
            "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
            "D": text.rlike(r"[#$%&*|]")}


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, key, mask, n): distinct rows with their number; ``mask``: filters failed, but for repeats."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    mask = sum((F.when(c, bit(f)).otherwise(0) for f, c in conditions(F.col("text"), F.col("words")).items()), F.lit(0))
    return (own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), mask.alias("mask"))
            .groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("n")))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic. ``labels``: (doc_id, quality, toxic)."""
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(one("quality").alias("good"), one("toxic").alias("toxic")))
    none = rows.filter("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    found = rows.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return found.unionByName(none)


def cells(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail."""
    by_text = staged(rows.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")), "audit-texts")
    least = by_text.groupBy("key").agg(F.min("first.doc_id").alias("least"), F.count("*").alias("held"))
    # Only texts that stand in several rows can be repeats of another row.
    several = by_text.join(least.filter("held > 1").drop("held"), "key", "left")
    first = (F.col("first.doc_id") == F.coalesce("least", "first.doc_id"))
    passed = F.col("no_id") + F.when(first, F.col("first.n")).otherwise(0)
    both = several.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), passed.alias("n")),
        F.struct((F.col("mask") + bit(REPEATS)).alias("mask"), (F.col("n") - passed).alias("n")))).alias("c"))
    count = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c)
    return both.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), count("good"), count("toxic"))


def selectors() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of every step of every order: (order, step, filter's axis), and the selectors for what is removed and kept."""
    orders, place, removed, kept = [], [], [], []
    for order in permutations(range(len(FILTERS))):
        for step, own in enumerate(order):
            out = np.full(len(FILTERS), ALL)
            out[list(order[:step])] = PASS
            left = out.copy()
            out[own], left[own] = FAIL, PASS
            orders.append("".join(FILTERS[a] for a in order))
            place.append((step + 1, own))
            removed.append(out)
            kept.append(left)
    return orders, np.array(place), np.array(removed), np.array(kept)


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(part, kind, selector): sums of the cells that each row of selectors picks. ``tensors``: part, kind, one axis per filter."""
    axes = "abcdefgh"[:len(FILTERS)]
    spec = f"yz{axes}," + ",".join(f"r{a}" for a in axes) + "->yzr"
    return np.einsum(spec, tensors, *[VECTORS[chosen[:, a]] for a in range(len(FILTERS))], optimize=True)


def contractions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the audit of each part. Frames: part, cells (mask, n, good, toxic)."""
    n = len(FILTERS)
    orders, place, removed, kept = selectors()
    step, own = place.T
    fails = np.full((n, n), ALL)
    alone = np.full((n, n), PASS)
    np.fill_diagonal(fails, FAIL)
    np.fill_diagonal(alone, FAIL)
    for frame in frames:
        for at in range(0, len(frame), STEP):
            some = frame.iloc[at:at + STEP]
            flat = np.zeros((len(some), 3, 1 << n), "int64")
            for i, held in enumerate(some["cells"]):
                for c in held:
                    flat[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
            # Axis 0 is the filter with the lowest bit.
            tensors = flat.reshape(len(some), 3, *[2] * n).transpose(0, 1, *range(n + 1, 1, -1))
            out, left = contract(tensors, removed), contract(tensors, kept)
            failed, unique = contract(tensors, fails), contract(tensors, alone)
            shapley = np.stack([out[:, 0, own == a].sum(1) for a in range(n)], 1)
            for i, part in enumerate(some["part"]):
                yield pd.DataFrame({
                    "part": part, "filter_order": orders, "step": step.astype("int32"), "kept": left[i, 0],
                    "removed": out[i, 0], "redundant": failed[i, 0][own] - out[i, 0], "unique_fails": unique[i, 0][own],
                    "good_lost": out[i, 1], "toxic_lost": out[i, 2], "shapley": shapley[i][own]})


SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: see the module's head."""
    counted = cells(labelled(patterns(docs, id_col, text_col, part_col), labels))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInPandas(contractions, SCHEMA)


# All 120 orders as joins of letters; a mask's bit of a letter is 1 << (its place).
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
      + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(CASE WHEN good THEN 1 ELSE 0 END) AS good,
        sum(CASE WHEN toxic THEN 1 ELSE 0 END) AS toxic FROM m GROUP BY part, mask),
f(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
      WHERE a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f
        AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
        coalesce(list_sum([1 << (ascii(substr(filter_order, i, 1)) - 65) for i in range(1, step)]), 0)::INT AS before
      FROM o, (VALUES (1), (2), (3), (4), (5)) v(step)),
r AS (SELECT part, filter_order, step, letter,
        sum(CASE WHEN mask & (own + before) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""


@case("op13_filter_audit", SQL)
def op13(spark, sf_dir):
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
