import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from joblode.llm import eliasfano, idfiles
from tests.llm.conftest import BYTE, TEXTS, WORD


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-2**62, 2**62) | st.integers(0, 500), max_size=700))
def test_rising_numbers(values):
    values = sorted(values)
    if values and values[-1] - values[0] > 2**62:
        values = values[:1]
    data = eliasfano.encode(np.array(values, "int64"))
    read = eliasfano.Rising(data)
    assert read.all().tolist() == values and len(read) == len(values)
    assert [read[i] for i in range(0, len(values), 7)] == values[::7]


def test_space():
    values = np.cumsum(np.full(100_000, 700))
    assert len(eliasfano.encode(values)) * 8 / len(values) < np.log2(700) + 3  # a plain table takes 64


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_files(spark, odd, tmp_path):
    for path, end, segment in ((WORD, 2, 1 << 20), (BYTE, 50256, 300)):
        place = str(tmp_path / f"ids{end}")
        idfiles.write_ids(odd, place, path, end, ranges=3, segment=segment)
        library = Tokenizer.from_file(path)
        ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t in TEXTS]
        got = sorted(idfiles.read_ids(spark, place).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [i for i, _ in ordered(TEXTS)]
        at = 0
        for r in got:
            assert r.start == at
            at += len(r.ids)
        assert sorted(str((r.doc_id, r.ids)) for r in got) == sorted(str(x) for x in ids)
        crcs = sorted(str((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in idfiles.read_digests(spark, place).collect())
        assert crcs == sorted(str((r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))) for r in got)


def test_empty(spark, empty, tmp_path):
    idfiles.write_ids(empty, str(tmp_path / "none"), WORD, 2)
    assert idfiles.read_digests(spark, str(tmp_path / "none")).count() == 0
