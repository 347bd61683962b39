"""Token-id tables: concatenated ids with Elias-Fano document boundaries.

A table is a Parquet folder, so that Spark's own writer commits it on any store
and a repeated task leaves no trace. Each row is a segment: the ids of some
consecutive documents in one byte string (two bytes an id where the vocabulary
allows, else four, the lowest first), the documents' boundaries and their ids
as Elias-Fano strings, and counts. ``part`` and ``segment`` give the order: by
rising document id over the whole table. A segment holds up to ``SEGMENT`` ids,
or one longer document.

Defined results: a null or empty text holds the end id alone; rows with a null
id stand first; rows with equal ids stand side by side, by text; an empty input
gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode.llm import eliasfano
from joblode.llm.bpe import encoder, texts_of
from joblode.llm.registry import case, documents
from joblode.llm.tokens import narrow
from joblode.session import scratch

SEGMENT = 1 << 20
SEGMENTS = ("part int, segment int, part_start long, n_docs long, n_null long, n_ids long, width int, ids binary, "
            "bounds binary, doc_ids binary")


def segments(sorted_docs: DataFrame, path: str, end_id: int, segment: int) -> DataFrame:
    """Segments of documents that are range-partitioned and sorted by id."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, forced=False)
        width = 2 if max(bpe.entries) < 2**16 and end_id < 2**16 else 4
        part, number, before = None, 0, 0
        ids, sizes, docs = [], [0], []

        def flush() -> pa.RecordBatch:
            nonlocal number, before
            whole = np.frombuffer(b"".join(ids), "<u4")
            known = [d for d in docs if d is not None]
            row = {"part": part, "segment": number, "part_start": before, "n_docs": len(docs), "n_null": len(docs) - len(known),
                   "n_ids": len(whole), "width": width, "ids": whole.astype(f"<u{width}").tobytes(),
                   "bounds": eliasfano.encode(np.cumsum(sizes)),
                   "doc_ids": eliasfano.encode(np.array(known, "int64"))}
            number, before = number + 1, before + len(whole)
            ids.clear()
            docs.clear()
            sizes[:] = [0]
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("segment", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int64()),
                ("n_null", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("bounds", pa.binary()),
                ("doc_ids", pa.binary())]))

        held = 0
        for batch, texts in texts_of(batches):
            part = batch.column("part")[0].as_py() if len(batch) else part
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                got = bpe.encode_bytes(text) + end
                if docs and held + len(got) // 4 > segment:
                    yield flush()
                    held = 0
                ids.append(got)
                docs.append(doc)
                sizes.append(len(got) // 4)
                held += len(got) // 4
        if docs:
            yield flush()
    return sorted_docs.mapInArrow(run, SEGMENTS)


def write_ids(docs: DataFrame, place: str, path: str, end_id: int, ranges: int | None = None,
              segment: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes documents to a new token-id table at ``place``, in rising order of their ids.

    The documents are dealt by ranges of ids before they are encoded, so that each text is encoded
    once and each task holds one range in order.
    """
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (narrow(docs, id_col, text_col).repartitionByRange(ranges or shuffle, F.col("doc_id"), F.xxhash64("text"))
             .sortWithinPartitions("doc_id", F.xxhash64("text"), "text").withColumn("part", F.spark_partition_id()))
    segments(dealt, path, end_id, segment).write.option("compression", "none").parquet(place)


def read_ids(spark: SparkSession, place: str) -> DataFrame:
    """(doc_id, start, ids) of a token-id table; ``start``: ids of all documents before it."""
    return _read(spark, place, "doc_id long, start long, ids array<int>", lambda ids: pa.array(
        [x.tolist() for x in ids], pa.list_(pa.int32())))


def read_digests(spark: SparkSession, place: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a token-id table."""
    return _read(spark, place, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())])


def _read(spark: SparkSession, place: str, schema: str, columns) -> DataFrame:
    rows = spark.read.schema(SEGMENTS).parquet(place)
    # Ids before each part: one number per range, so of a size that the number of ranges bounds.
    counts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for row in counts:
        before[row["part"]] = total
        total += row["n"]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                bounds = eliasfano.Rising(row["bounds"]).all()
                docs = [None] * row["n_null"] + eliasfano.Rising(row["doc_ids"]).all().tolist()
                made = columns(np.split(ids, bounds[1:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(before[row["part"]] + row["part_start"] + bounds[:-1], pa.int64()),
                     *(made if isinstance(made, list) else [made])], names=names)
    return rows.mapInArrow(run, schema)


@case("op10_token_id_files")
def op10(spark, sf_dir):
    import public_tokenizers

    place = scratch(spark, "ids")
    write_ids(documents(spark, sf_dir), place, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_digests(spark, place)
