import random
from collections import Counter

import numpy as np
import pytest

from joblode.llm import neardup
from joblode.llm.bagminhash import bands, mix, signatures
from joblode.llm.components import components
from tests.llm.conftest import TEXTS, frame


def bag(text):
    words = (text or "").split()
    size = min(5, len(words))
    return Counter(tuple(words[k:k + size]) for k in range(len(words) - size + 1)) if words else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def classes(rows, least=0.8):
    """Connected components by comparing all pairs."""
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    bags = [bag(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or similarity(bags[a], bags[b]) >= least - 1e-12:
                group[root(a)] = root(b)
    last = lambda i: (i is None, i)
    members = {}
    for n, (i, _) in enumerate(rows):
        members.setdefault(root(n), []).append(i)
    return sorted(str((i, min(members[root(n)], key=last), len(members[root(n)]))) for n, (i, _) in enumerate(rows)), len(members)


def check(df, rows):
    got = neardup.near_groups(df).collect()
    want, count = classes(rows)
    assert sorted(str((r.doc_id, r.class_id, r.group_size)) for r in got) == want
    assert sum(r.kept for r in got) == count and all(r.doc_id == r.class_id for r in got if r.kept)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    for _ in range(4):
        a = {int(x): int(w) for x, w in zip(rng.integers(0, 200, 60), rng.integers(1, 12, 60))}
        b = {k: (v if rng.random() < 0.7 else int(rng.integers(1, 20))) for k, v in a.items()}
        want = sum(min(a[k], b[k]) for k in a) / sum(max(a[k], b[k]) for k in a)
        sig = signatures(np.repeat([0, 1], [len(a), len(b)]), mix(np.array([*a, *b], "uint64")),
                         np.array([*a.values(), *b.values()]), 2, 4096)
        assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    assert bands(sig, 8).shape == (2, 512)


def test_multiset_as_set():
    rng = random.Random(4)
    for _ in range(50):
        a, b = (" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(2))
        x, y = set(neardup.elements(a).tolist()), set(neardup.elements(b).tolist())
        assert len(x) == sum(bag(a).values()) and len(x & y) == sum((bag(a) & bag(b)).values())


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words]


def near_rows(seed, groups=6, size=12):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        words = [f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(40, 300))]
        for k in range(size):
            words_k = edited(rng, words, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))
            rows.append((len(rows), " ".join(words_k)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = near_rows(seed)
    check(frame(spark, rows).repartition(3), rows)


def test_one_large_group(spark):
    rows = near_rows(3, groups=1, size=150) + [(1000 + i, "equal text of six words here") for i in range(100)]
    check(frame(spark, rows), rows)


def test_chain_is_one_class(spark):
    words = [f"c{i}" for i in range(60)]
    rows = []
    for k in range(12):  # each is near its neighbours only
        rows.append((k, " ".join(words)))
        words = words[4:] + [f"d{k}{j}" for j in range(4)]
    check(frame(spark, rows), rows)
    assert len({r.class_id for r in neardup.near_groups(frame(spark, rows)).collect()}) == 1


def test_given_documents(small):
    check(small, [(r.doc_id, r.text) for r in small.collect()])


def test_odd(odd, empty):
    check(odd, TEXTS)
    assert neardup.near_groups(empty).count() == 0


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 200)]
    links += [(2000 + k, 2001 + k) for k in range(40)]
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        group[b] = a
    want = {(n, root(n)) for n in group if root(n) != n}
    assert {tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect()} == want


def test_workers_keep_few_words():
    """What stays in a worker after many different words is small: it adds to the memory of every later stage."""
    import gc
    import tracemalloc

    texts = [" ".join(f"w{i}-{j}" for j in range(10_000)) for i in range(40)]
    neardup._WORDS.clear()
    tracemalloc.start()
    neardup._signed(texts, neardup.BANDS, neardup.ROWS)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    neardup._WORDS.clear()
    assert held < 24 << 20
