"""Sharding along a Hilbert curve, in DataFrame operations only.

Several columns are quantised to ``bits`` bits each by their quantiles, rows are
ordered by the cell's place on the Hilbert curve through the grid, and the order
is cut into runs of equal numbers of rows. Rows near each other in all columns
lie in the same or in neighbouring shards, so that the shards' minima and maxima
let a reader skip shards by any of the columns.

Rows are ranked without one large task: they are dealt by ranges of the curve
and sorted there, and each range adds the rows of the ranges before it.

Defined results: a null dimension comes before all values; a null text has a
size of 8 and checksum 0; rows with equal keys are all placed, one by one; ties
on the curve are broken by id, checksum and size; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblode.llm.registry import case, documents
from joblode.session import staged

# A string dimension stays a string; all others are ordered as doubles.


def ordered_value(df: DataFrame, column: str) -> Column:
    """The column as it is ordered: strings by their bytes, others by their number."""
    kind = dict(df.dtypes)[column]
    if kind == "string":
        return F.col(column)
    if kind in ("timestamp", "date"):
        return F.col(column).cast("timestamp").cast("double")
    return F.col(column).cast("double")


def string_cuts(df: DataFrame, dim: str, bits: int) -> list[tuple[str, int]]:
    """(value, by how much the bucket grows there): fewer than 2**bits, from the exact ranks of all rows.

    Values are counted, dealt by ranges and summed up there, each range adding the rows of the
    ranges before it; only the values at which a bucket begins come to the driver.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(dim).isNotNull()).groupBy(dim).agg(F.count("*").alias("_n"))
    placed = staged(counts.repartitionByRange(ranges, dim).withColumn("_part", F.spark_partition_id()), "curve-values")
    # One row per range: few enough for one task.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum("_n").alias("_rows"))
    starts = totals.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    total = totals.agg(F.sum("_rows")).first()[0] or 1
    own = Window.partitionBy("_part").orderBy(dim)
    through = placed.join(F.broadcast(starts), "_part").withColumn("_to", F.col("_start") + F.sum("_n").over(own))

    def level(rows: Column) -> Column:
        return F.least(F.floor(rows * F.lit(2**bits) / F.lit(total)), F.lit(2**bits - 1))

    grown = through.select(dim, (level(F.col("_to")) - level(F.col("_to") - F.col("_n"))).cast("int").alias("grown"))
    return sorted((r[0], r[1]) for r in grown.filter("grown > 0").collect())


def cells(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """``df`` with each dimension (a double or a string) replaced by its bucket, 0 to 2**bits - 1.

    The cut points are quantiles of all rows: fewer than 2**bits values for each dimension.
    """
    shares = [i / 2**bits for i in range(1, 2**bits)]
    strings = [d for d in dims if dict(df.dtypes)[d] == "string"]
    numbers = [F.percentile_approx(d, shares, 10_000).alias(d) for d in dims if d not in strings]
    cuts = df.agg(*numbers).first().asDict() if numbers else {}
    for d in dims:
        # A value that many rows have is a cut point several times: it takes as much of the axis.
        points = string_cuts(df, d, bits) if d in strings else sorted(Counter(c for c in cuts[d] or [] if c == c).items())
        over = [F.when(F.col(d) >= F.lit(c), n).otherwise(0) for c, n in points]
        df = df.withColumn(d, reduce(lambda a, b: a + b, over, F.lit(0)))
    return df


def hilbert_index(df: DataFrame, dims: list[str], bits: int, name: str) -> DataFrame:
    """``df`` with the place on the Hilbert curve of the cell that ``dims`` name; ``dims`` are consumed.

    Skilling's transform: each step is a projection of its own, so that every intermediate number is
    computed once and all of them in generated code.
    """
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for d in dims:
            first, own, low = F.col(dims[0]), F.col(d), F.lit(q - 1)
            swap = first.bitwiseXOR(own).bitwiseAND(low)
            on = own.bitwiseAND(F.lit(q)) != 0
            new = {dims[0]: F.when(on, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))}
            if d != dims[0]:
                new[d] = F.when(on, own).otherwise(own.bitwiseXOR(swap))
            df = df.withColumns(new)
        q >>= 1
    for before, d in zip(dims, dims[1:]):
        df = df.withColumn(d, F.col(d).bitwiseXOR(F.col(before)))
    turn, q = F.lit(0), top
    while q > 1:
        turn = turn.bitwiseXOR(F.when(F.col(dims[-1]).bitwiseAND(F.lit(q)) != 0, q - 1).otherwise(0))
        q >>= 1
    df = df.withColumn("_turn", turn)
    df = df.withColumns({d: F.col(d).bitwiseXOR(F.col("_turn")) for d in dims})
    places = [(bit, d) for bit in reversed(range(bits)) for d in dims]
    index = reduce(lambda a, b: a + b, [
        F.shiftleft(F.shiftright(d, bit).bitwiseAND(F.lit(1)).cast("long"), len(places) - 1 - n)
        for n, (bit, d) in enumerate(places)])
    return df.withColumn(name, index).drop(*dims, "_turn")


def ranked(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``df`` with each row's rank from 0 in ``order``, and the number of rows."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id counts rows within a range in its low 33 bits; it is written before it is used.
    placed = staged(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
                    .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).cast("int").alias("_part")
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"))
    # One row per range: few enough for one task.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = (placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
           .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)))
           .drop("_part", "_at", "_start"))
    return out, placed.count()


def even_runs(rank: Column, rows: int, shards: int) -> tuple[Column, Column]:
    """(shard, slot) of a rank: runs whose lengths differ by one at most."""
    short, longer = divmod(rows, shards)
    edge = longer * (short + 1)
    after = rank - F.lit(edge)
    size = max(short, 1)
    shard = F.when(rank < edge, F.floor(rank / (short + 1))).otherwise(longer + F.floor(after / size))
    slot = F.when(rank < edge, rank % (short + 1)).otherwise(after % size)
    return shard.cast("int"), slot.cast("long")


def curve_shards(docs: DataFrame, dims: list[str], shards: int, bits: int = 5, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot): each row's shard and its place there.

    ``dims`` name columns of ``docs``; ``size`` (bytes of the text plus 8) may be one of them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
           F.crc32(text).alias("text_crc32")]
    names = [f"_dim{n}" for n in range(len(dims))]
    values = [ordered_value(docs, d).alias(n) if d != "size" else
              (F.octet_length(text) + 8).cast("double").alias(n) for d, n in zip(dims, names)]
    rows = staged(docs.select(*own, *values), "curve-rows")  # texts are read once
    rows = hilbert_index(cells(rows, names, bits), names, bits, "curve")
    rows, count = ranked(rows, ["curve", "doc_id", "text_crc32", "size"], "rank")
    shard, slot = even_runs(F.col("rank"), count, shards)
    return rows.select("doc_id", "size", "text_crc32", "curve", shard.alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes documents, whose ids are unique, to one folder per shard, in the order of the curve."""
    place = placed.select(F.col("doc_id").alias("_id"), "shard", "slot")
    shards = docs.join(place, F.col(id_col).cast("long").eqNullSafe(F.col("_id"))).drop("_id")
    (shards.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .drop("slot").write.partitionBy("shard").parquet(path))


@case("op6_hilbert_shards")
def op6(spark, sf_dir):
    placed = curve_shards(documents(spark, sf_dir), ["lang", "source", "size"], 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")
