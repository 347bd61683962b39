import hashlib
import re
from collections import defaultdict

import pytest

from joblode.llm import exact
from tests.llm.conftest import TEXTS, frame


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[digest(t)].append(i)
    last = lambda i: (i is None, i)
    return sorted(((i, min(groups[digest(t)], key=last), len(groups[digest(t)]), digest(t)) for i, t in rows), key=str)


@pytest.mark.parametrize("few", [True, False])
def test_groups(spark, odd, monkeypatch, few):
    if not few:
        monkeypatch.setattr(exact, "BROADCAST_KEYS", 0)
    got = exact.exact_groups(odd, digest_all=True).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(TEXTS)
    lazy = exact.exact_groups(odd).collect()
    key = lambda r: (r.doc_id, r.keep_id, r.group_size, r.kept)
    assert sorted(map(key, got), key=str) == sorted(map(key, lazy), key=str)
    assert all((r.text_sha256 is None) == (r.group_size == 1) for r in lazy)
    assert sum(r.kept for r in got) == len({digest(t) for _, t in TEXTS})


def test_rows_kept(odd):
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == len({digest(t) for _, t in TEXTS}) == len({digest(r.text) for r in rows})
    assert {r.doc_id for r in rows if r.text == "twice"} == {8}


def test_large_group(spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, f"other {i}") for i in range(50)]
    got = exact.exact_groups(frame(spark, rows)).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 500} == {(0, 500)}
    assert sum(r.kept for r in got) == 51


def test_empty(empty):
    assert exact.exact_groups(empty).count() == 0 and exact.drop_copies(empty).count() == 0
