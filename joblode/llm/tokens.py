"""Documents to token ids and back, in Arrow batches.

One row per row of the input, repeated rows too. Only the id and text columns
are read, so other columns may have any name. A null id stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm.bpe import encoder, texts_of
from joblode.llm.registry import case, documents


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of documents whose columns may be named and typed otherwise."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch, texts in texts_of(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int32()))],
                names=["doc_id", "ids"])
    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch, ids in texts_of(batches, "ids"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([bpe.decode(x or []) for x in ids], pa.string())],
                names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, of which only
    digests leave the worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch, texts in texts_of(batches):
            counts, ids_hex, texts_hex = [], [], []
            for text in texts:
                ids = bpe.encode(text)
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                texts_hex.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(texts_hex)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return narrow(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@case("op4_bpe_round_trip")
def op4(spark, sf_dir):
    import public_tokenizers

    return round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
