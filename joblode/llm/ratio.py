"""Quality rules with a hashed n-gram likelihood ratio, in DataFrame operations only.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials over
the buckets are counted with partial aggregates: one over the trusted target,
one over the whole raw corpus. A document's score is the mean, over its words
and pairs, of log(target / raw), so that length does not count. Every document
is held against one threshold: the score that the share ``REJECT`` of the
trusted documents stays under. No document is drawn at random.

Base rules need the text alone: counts of words, symbols, repeated lines, and
words in five-word windows that stand twice or more in the text.

Defined results: a null text has no words; a text without words scores 0 and
fails the base rules; without trusted documents all scores are 0 and the base
rules alone decide; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.functions.text import let
from joblode.llm.registry import case, documents
from joblode.session import staged

BUCKETS = 1 << 14
WINDOW = 5
# Trusted ids, of 8 bytes each, that are sent to every task.
BROADCAST_IDS = 2_000_000
# Share of trusted documents that the threshold gives up.
REJECT = 0.002
SPACE = r"[ \t-\r]+"


def words_of(text: Column) -> Column:
    """Words of a text in one expression."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t-\r]+|[ \t-\r]+\z", "")
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def with_words(df: DataFrame, text: Column, name: str = "_words") -> DataFrame:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t-\r]+|[ \t-\r]+\z", "")
    return df.withColumn("_trimmed", trimmed).withColumn(name, F.when(
        F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPACE))).drop("_trimmed")


def with_hashes(df: DataFrame) -> DataFrame:
    """Adds ``_h1`` and ``_h2``: hashes of all words and of all pairs of words that follow each other."""
    return df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_h2", paired("_h1", "_h1", 1))


def paired(a: str, b: str, apart: int) -> Column:
    """Hash of each element of ``a`` with the one of ``b`` that stands ``apart`` places later, while there is one."""
    count = F.greatest(F.least(F.size(a), F.size(b) - apart), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), count), F.slice(b, F.lit(apart + 1), count), lambda x, y: F.xxhash64(x, y))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; needs text, _words, _h1 and _h2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    df = docs.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "_lines": lines, "_four": paired("_h2", "_h2", 2)})
    df = df.withColumn("_windows", paired("_four", "_h1", WINDOW - 1))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Windows that recur are sorted with their places; only texts that have such windows pay for it.
    recurs = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(recurs, F.array_sort(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = lambda x, k: x["h"] == F.get("_sorted", k)["h"]
    df = df.withColumn("_places", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.filter(F.transform(
        "_sorted", lambda x, k: F.when(F.coalesce(equal(x, k - 1), F.lit(False))
                                       | F.coalesce(equal(x, k + 1), F.lit(False)), x["i"])),
        lambda i: i.isNotNull()))))
    covered = F.aggregate("_places", F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), lambda acc, i: F.struct(
        (acc["sum"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("sum"), i.alias("last")))["sum"]
    return (df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
            .drop("_lines", "_four", "_windows", "_sorted", "_places"))


def bucket(h: Column, count: int) -> Column:
    return F.pmod(h, F.lit(count)).cast("int")


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``docs`` with a column ``trusted``; few trusted ids go to every task, many are joined by a shuffle."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    ids = ids.withColumn("trusted", F.lit(True))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left")


def bucket_counts(docs: DataFrame, count: int) -> list[tuple[int, int, int]]:
    """(bucket, in the raw corpus, in trusted documents): at most ``count`` rows. Needs text and trusted."""
    grams = with_hashes(with_words(docs, F.col("text"))).select("trusted", F.explode(F.concat("_h1", "_h2")).alias("h"))
    return [tuple(r) for r in grams.groupBy(bucket(F.col("h"), count).alias("b")).agg(F.count("*"), F.count("trusted")).collect()]


def log_ratios(counts: list[tuple[int, int, int]], count: int) -> list[float]:
    """log(target / raw) of every bucket, with one added to each count."""
    raw, target = [1] * count, [1] * count
    for b, r, t in counts:
        raw[b] += r
        target[b] += t
    if sum(target) == count:
        return [0.0] * count
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for r, t in zip(raw, target)]


def scored(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds score; needs _h1 and _h2."""
    table = F.lit(np.array(ratios))
    add = lambda total, h: total + F.get(table, bucket(h, len(ratios)))
    total = F.aggregate("_h2", F.aggregate("_h1", F.lit(0.0), add), add)
    grams = F.size("_h1") + F.size("_h2")
    return docs.withColumn("score", F.when(grams > 0, total / grams).otherwise(0.0))


def ratio_rules(docs: DataFrame, trusted: DataFrame, count: int = BUCKETS, reject: float = REJECT,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the base counts, base_failed, score, threshold, kept): one row per row of ``docs``.

    ``trusted``: (doc_id) of the documents that make up the target.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = marked(own, trusted)
    ratios = log_ratios(bucket_counts(own, count), count)
    read = staged(scored(base_counts(with_hashes(with_words(own, F.col("text")))), ratios)
                  .drop("text", "_words", "_h1", "_h2"), "ratio-scores")
    floor = read.filter("trusted AND n_words > 0").agg(F.percentile_approx("score", F.lit(reject), F.lit(100_000))).first()[0]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    above = F.lit(True) if floor is None else F.col("score") >= F.lit(floor)
    return read.drop("trusted").withColumn("base_failed", failed).withColumn("threshold", F.lit(floor).cast("double")).withColumn(
        "kept", ~F.col("base_failed") & above)


@case("op5_ratio_rules")
def op5(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = ratio_rules(documents(spark, sf_dir), labels.filter("quality = 1").select("doc_id"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "score")
