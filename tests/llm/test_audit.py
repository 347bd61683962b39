import re
from itertools import permutations

import numpy as np
import pytest

from joblode.llm import audit as A
from tests.llm.conftest import frame


def brute(rows, labels):
    """Filters one document at a time. rows: (doc_id, text, part)."""
    found = []
    for doc, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
                 "D": any(c in "#$%&*|" for c in text), "E": smaller}
        own = [(q, t) for d, q, t in labels if d == doc and d is not None]
        found.append((part or "", fails, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out = {}
    for part in {p for p, *_ in found}:
        docs = [(f, g, t) for p, f, g, t in found if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows_of = {}
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if d[0][letter]]
                left = [d for d in left if not d[0][letter]]
                failing = sum(d[0][letter] for d in docs)
                shapley[letter] += len(gone)
                rows_of[part, order, step] = [len(left), len(gone), failing - len(gone),
                                              sum([k for k, v in d[0].items() if v] == [letter] for d in docs),
                                              sum(g for _, g, _ in gone), sum(t for *_, t in gone)]
        for (p, order, step), values in rows_of.items():
            out[p, order, step] = (*values, shapley[order[step - 1]])
    return out


def got(df):
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.collect()}


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, part string, n int")


LONG = " ".join(f"w{i % 171}" for i in range(400))
ROWS = [(1, LONG, "a"), (2, LONG, "b"), (3, LONG, None), (3, LONG, "a"), (None, LONG, "a"), (None, LONG, "a"), (4, None, "a"),
        (5, "", "a"), (6, "UP & down", "b"), (7, " ".join(f"x{i}" for i in range(300)) + " $", None), (0, "é " * 250, "")]
LABELS = [(1, 1, 0, "z", 1), (1, 0, 1, "z", 1), (2, None, 1, "z", 1), (None, 1, 1, "z", 1), (7, 1, None, "z", 1), (99, 1, 1, "z", 1)]


def test_against_one_by_one(spark):
    docs = frame(spark, ROWS, "doc_id long, text string, source string, part string, mask int, n int, key string").repartition(3)
    assert got(A.audit(docs, labels_of(spark, LABELS))) == brute(ROWS, [r[:3] for r in LABELS])


def test_odd_rows(odd, spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert got(A.audit(odd, labels_of(spark, LABELS))) == brute(rows, [r[:3] for r in LABELS])


def test_one_text_and_one_id_hold_many_rows(spark):
    rows = [(i, "same words", f"s{i % 3}") for i in range(300)] + [(7, f"text {i}", "s1") for i in range(200)]
    docs = frame(spark, rows, "doc_id long, text string, source string").repartition(4)
    assert got(A.audit(docs, labels_of(spark, LABELS))) == brute(rows, [r[:3] for r in LABELS])


def test_empty(empty, spark):
    assert A.audit(empty, labels_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_contract(seed):
    tensors = np.random.default_rng(seed).integers(0, 9, (2, 3, 2, 2, 2, 2, 2))
    chosen = np.random.default_rng(seed).integers(0, 3, (7, 5))
    out = A.contract(tensors, chosen)
    for r, pick in enumerate(chosen):
        part = tensors[(slice(None), slice(None), *[slice(None) if p == A.ALL else slice(p, p + 1) for p in pick])]
        assert (out[:, :, r] == part.sum((2, 3, 4, 5, 6))).all()
