import math
import re
from collections import Counter

import numpy as np
import pytest

from joblode.llm import dualtree as D
from tests.llm.conftest import frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    total, size = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in counted:
            m = 10 + (90 * n * total) // size
            scores.append((sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                               * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c), doc))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, n, doc, score) for n, (score, doc) in enumerate(best, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long, item int")


ITEMS = [(1, "hello WORLD end"), (2, None), (3, ""), (4, "w1 w2 w3 x5"), (4, "twice"), (None, "Σίσυφος 日本語 words"), (5, "nowhere"),
         (6, "a b c d e f g"), (7, "x" * 5000)]


def test_odd_rows(odd, spark):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = D.search(odd, items_of(spark, [(*i, 3, 4) for i in ITEMS]))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == brute(docs, ITEMS)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    words = np.array([f"t{i}" for i in range(400)])
    def text(a, b):  # noqa: E306
        return " ".join(words[np.minimum(rng.zipf(1.3, rng.integers(a, b)) - 1, 399)])
    docs = [(int(rng.integers(0, 900)), text(0, 60)) for _ in range(1200)]
    docs += [(i, docs[0][1]) for i in range(2000, 2600)]  # ties of a third of all rows
    items = [(i, text(1, 12)) for i in range(70)]
    monkeypatch.setattr(D, "BLOCK_ITEMS", 40)
    monkeypatch.setattr(D, "TREE", 100)
    found = D.search(frame(spark, docs, "doc_id long, text string").repartition(3), items_of(spark, [(*i, 1, 2) for i in items]), 7)
    assert got(found) == brute(docs, items, 7)


def test_bounds_drop_batches():
    """With a known kth score, whole batches are dropped: few products are taken."""
    rng = np.random.default_rng(1)
    width, count = 300, 512
    term = np.concatenate([np.sort(rng.choice(np.arange(g // 64 * 30, g // 64 * 30 + 60), 20, replace=False)) for g in range(count)])
    leaves = D.Level(np.repeat(np.arange(count), 20), term, np.full(len(term), 10), count)
    weights = np.ones(width, "int64")
    sets = [np.arange(12), np.arange(8, 20)]
    taken = []
    items = D.Items(sets, weights, np.full(2, 60), 3)
    inner = items.products
    items.products = lambda *a: taken.append(1) or inner(*a)
    D.search_tree(items, list(range(count)), leaves, width)
    assert 0 < len(taken) < count / 2
    for at, best in enumerate(items.best):
        own = sets[items.order[at]]
        scores = sorted((10 * len(np.intersect1d(own, term[d * 20:d * 20 + 20])) for d in range(count)), reverse=True)
        assert sorted((s for s, *_ in best), reverse=True) == [s for s in scores[:3] if s >= 60]


def test_empty(empty, odd, spark):
    assert D.search(empty, items_of(spark, [(*i, 3, 4) for i in ITEMS])).count() == 0
    assert D.search(odd, items_of(spark, [])).count() == 0
