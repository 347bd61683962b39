"""Packing of documents into sequences: first-fit decreasing in randomised groups.

Each document's ids and its end id are cut every ``length`` ids; the pieces are
dealt at random (by a hash) into groups of about ``GROUP`` documents. Each group
is packed on its own: pieces by falling length, each into the first sequence
with room for it, which a tournament tree over the free room finds in
logarithmic time. A group never depends on another, so a lost task repeats
only its own, with the same result.

Defined results: a null or empty text is one piece that holds the end id; rows
with the same or a null id are packed one by one; no rows give no sequences.
Ties in length are broken by id, start and then checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm.bpe import encoder, texts_of
from joblode.llm.registry import case, documents
from joblode.llm.tokens import narrow
from joblode.session import staged

# Documents in a group, on average: enough that the last, half-full sequence of a group does not count.
GROUP = 4_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class Rooms:
    """Free room of sequences 0, 1, 2 ... as a tournament tree: a node holds the larger of its two
    children, so that the first sequence with enough room is found from the root down."""

    def __init__(self, count: int, room: int):
        self.leaves = 1 << max(0, count - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Puts ``size`` into the first sequence that has the room: its number, and the room it had."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        had, found = most[at], at - self.leaves
        most[at] = had - size
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found, had


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; ``sizes`` fall and are at most ``length``."""
    whole = int(np.searchsorted(-sizes, -length, side="right"))  # these fill a sequence each
    sequence, offset = np.arange(len(sizes)), np.zeros(len(sizes), "int64")
    rooms = Rooms(len(sizes) - whole, length)
    for n, size in enumerate(sizes[whole:].tolist(), whole):
        at, had = rooms.take(size)
        sequence[n], offset[n] = whole + at, length - had
    return sequence, offset


def pieces(docs: DataFrame, path: str, length: int, end_id: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids, cut every ``length`` ids."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, forced=False)
        for batch, texts in texts_of(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids = memoryview(bpe.encode_bytes(text) + end)
                total = len(ids) // 4
                rows += [(doc, a, min(length, total - a), zlib.crc32(ids[4 * a:4 * (a + length)]), total)
                         for a in range(0, total, length)]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return narrow(docs, id_col, text_col).mapInArrow(run, PIECES)


def packer(length: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        sequence, offset = first_fit_decreasing(group["length"].to_numpy("int64"), length)
        # A group's number, then the sequence's number in it: unique over all groups.
        group["sequence_id"] = (int(key[0]) << 32) + sequence
        group["offset"] = offset
        return group.drop(columns="group")
    return run


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, group: int = GROUP,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where its ids stand in the document and in which sequence, at which offset."""
    groups = max(1, -(-docs.count() // group))
    # Groups are drawn by the number of a written row, so that equal or null ids do not meet in one.
    cut = staged(pieces(docs, path, length, end_id, id_col, text_col), "pieces")
    return (cut.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
            .groupBy("group").applyInPandas(packer(length), PACKED))


@case("op9_packing")
def op9(spark, sf_dir):
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
