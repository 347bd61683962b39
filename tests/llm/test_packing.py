import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from joblode.llm import packing
from tests.llm.conftest import BYTE, TEXTS, frame


def test_first_fit_by_tree():
    rng = random.Random(5)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 64) for _ in range(rng.randrange(1, 120))), reverse=True)
        rooms, want = [], []
        for s in sizes:
            at = next((n for n, r in enumerate(rooms) if r >= s), None)
            if at is None:
                at = len(rooms)
                rooms.append(64)
            want.append((at, 64 - rooms[at]))
            rooms[at] -= s
        got = packing.first_fit_decreasing(np.array(sizes), 64)
        assert list(zip(*[x.tolist() for x in got])) == want


def whole(rows, got, length):
    library = Tokenizer.from_file(BYTE)
    left = defaultdict(int)
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), length):
            part = np.array(ids[a:a + length], "<u4").tobytes()
            left[i, a, len(part) // 4, zlib.crc32(part), len(ids)] += 1
    for r in got:
        left[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] -= 1
    assert not any(left.values())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return sequences


@pytest.mark.parametrize("length,group", [(1024, 4000), (64, 3)])
def test_each_id_once(odd, length, group):
    whole(TEXTS, packing.pack(odd, BYTE, length, group=group).collect(), length)


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.pack(docs, BYTE).collect()
    sequences = whole(rows, got, 1024)
    assert sum(r.length for r in got) > 0.97 * 1024 * len(sequences)


def test_empty(empty, spark):
    assert packing.pack(empty, BYTE).count() == 0
    assert packing.pack(frame(spark, [(None, None)]), BYTE).collect()[0].length == 1


def test_one_id_for_many_rows(spark):
    """Rows with one id, or none, are dealt out to groups like others."""
    docs = frame(spark, [(None if i % 2 else 7, f"text {i} " * 30) for i in range(600)], "doc_id long, text string")
    rows = packing.pack(docs, BYTE, group=50).collect()
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"] >> 32, []).append(r)
    assert len(rows) == 600 and len(held) == 12 and max(map(len, held.values())) < 100
