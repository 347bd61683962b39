import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from joblode.llm import metric as M
from tests.llm.conftest import frame


def set_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) of every row, by all pairs."""
    sets = [set_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    # Rows with an empty set have no class but their own.
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_odd_rows(odd):
    assert got(M.jaccard_classes(odd)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_empty(empty):
    assert M.jaccard_classes(empty).count() == 0


def edited(rng, words, count, by):
    words = list(words)
    for at in rng.choice(len(words), count, replace=False):
        words[at] = f"{by}{rng.integers(1 << 30)}"
    return words


def clouds(rng):
    """Texts around a few others at distances that straddle the threshold, chains of edits, and texts of their own."""
    rows, n = [], 0
    for c in range(4):
        base = [f"c{c}w{i}" for i in range(rng.integers(60, 200))]
        for _ in range(60):
            rows.append((n, " ".join(edited(rng, base, int(rng.integers(0, 5)), "e"))))
            n += 1
        chain = base
        for _ in range(12):  # each linked with the next, far from the first
            chain = edited(rng, chain, 1, "k")
            rows.append((n, " ".join(chain)))
            n += 1
        for cut in range(0, 12, 2):
            rows.append((n, " ".join(base[cut:])))
            n += 1
    common = [f"common{i}" for i in range(50)]
    for i in range(80):
        rows.append((n, " ".join(common + [f"own{n}x{j}" for j in range(int(rng.integers(0, 60)))])))
        n += 1
    return [rows[i] for i in rng.permutation(len(rows))]


def test_against_all_pairs(spark):
    rows = clouds(np.random.default_rng(0))
    assert got(M.jaccard_classes(frame(spark, rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_recursion_and_boundary(spark, monkeypatch):
    """Links between members of two regions, which neither pivot has, come from the deeper step."""
    rng, deeper = np.random.default_rng(5), []
    inner = M.region_links

    def watched(*a, **k):
        deeper.append(a[5] if len(a) > 5 else 0)
        return inner(*a, **k)
    monkeypatch.setattr(M, "region_links", watched)
    rows = []
    for c in range(4):  # two clouds, and between them two texts that alone link them
        steps = [[f"c{c}w{i}" for i in range(200)]]
        for k in range(6):
            steps.append([w if i != 20 * k + 5 else f"c{c}k{k}" for i, w in enumerate(steps[-1])])
        near = [steps[0], steps[6]] + [edited(rng, steps[k], 1, "e") for k in (0, 6) for _ in range(8)]
        rows += [(100 * c + i, " ".join(t)) for i, t in enumerate([*near, steps[2], steps[4]])]
    assert got(M.jaccard_classes(frame(spark, rows, "doc_id long, text string").repartition(3))) == brute(rows)
    assert max(deeper) > 0


def test_words_over_parts(monkeypatch):
    texts = [None, "", "A", "a b", "É x É x É x", "x" * 5000 + " y Z", "ab Cd " * 3000, " \t"]
    whole = M.sets_of(texts)
    assert [len(s) for s in whole] == [len(set_of(t)) for t in texts]
    monkeypatch.setattr(M, "STEP", 64)
    assert all((a == b).all() for a, b in zip(whole, M.sets_of(texts)))


@pytest.mark.parametrize("rows", [0, 1_000, 600_000])
def test_places_stay_sparse(spark, rows):
    """Every element's place is marked, and few others by chance, however many elements there are."""
    tokens = spark.range(rows).select(F.xxhash64("id").alias("element"))
    places = M.places_of(tokens)
    own = tokens.toArrow()["element"].to_numpy().view("uint64") % np.uint64(8 * len(places))
    bits = np.unpackbits(places, bitorder="little")
    assert bits[own.astype("int64")].all() and bits.sum() == len(np.unique(own))
    assert bits.mean() <= 1 / 8


def test_only_sets_of_pairs_are_measured(spark, plan):
    """Sets that no pair names stay where they are: they are ruled out before the shuffle."""
    sets = spark.createDataFrame([(i, list(range(i, i + 20))) for i in range(50)], "node long, elements array<long>")
    pairs = spark.createDataFrame([(1, 2), (30, 3), (4, 4)], "u long, v long")
    assert {r["node"] for r in M.sets_in(sets, pairs, "u").collect()} == {1, 30, 4}
    assert "LeftSemi" in plan(M.measured(pairs, sets))
    got = {(r["u"], r["v"]): (r["dist"], r["linked"]) for r in M.measured(pairs, sets).collect()}
    assert got == {(1, 2): (1 - 19 / 21, True), (30, 3): (1.0, False), (4, 4): (0.0, True)}


def test_fine_marks_tell_large_sets_apart(spark):
    """Large sets that share little pass the coarse marks but not the fine ones; no pair that is near is ruled out."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(1 << 63, size=9000, dtype="uint64"))
    sets = [base, np.unique(np.concatenate([base[:8500], rng.integers(1 << 63, size=300, dtype="uint64")])),
            np.unique(rng.integers(1 << 63, size=9000, dtype="uint64")), base[:4000], base[:4600], base[:5]]
    table = spark.createDataFrame(
        [(i, len(s), M.marks_of(s).tolist(), M.fine_marks_of(s).tolist()) for i, s in enumerate(sets)],
        "node long, n long, marks array<long>, fine array<long>")
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(i)], "u long, v long")

    def alike(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return both / (len(sets[i]) + len(sets[j]) - both)
    for least in (0.9, 0.8, 0.7):
        coarse = {tuple(r) for r in M.possible(pairs, table, F.lit(least)).collect()}
        fine = {tuple(r) for r in M.finely_possible(pairs, table, F.lit(least)).collect()}
        near = {(i, j) for i in range(6) for j in range(i) if alike(i, j) >= least}
        assert near <= fine <= coarse and (2, 0) in coarse and (2, 0) not in fine
    # A longer list is folded to the shorter one's length.
    assert len(M.fine_marks_of(sets[3])) * 2 == len(M.fine_marks_of(sets[4]))
    both = table.filter("node = 3").select(F.col("fine").alias("a")).crossJoin(table.filter("node = 4").select(F.col("fine").alias("b")))
    want = np.unpackbits((M.marks_of(sets[3], 64) ^ M.marks_of(sets[4], 64)).view("uint8")).sum()
    assert both.select(M.fine_unlike("a", "b")).first()[0] == want


def test_whole_sets_only_of_pairs_that_marks_allow(spark, monkeypatch):
    """Large texts of which any two share a passage: no whole set is made of them."""
    made, inner = [], M.set_table
    monkeypatch.setattr(M, "set_table", lambda docs, rows, elements=True: (
        made.append(rows.count()) if elements else None, inner(docs, rows, elements))[1])
    rows = [(k, " ".join(f"{min(j, k)}and{max(j, k)}at{i}" for j in range(4) if j != k for i in range(2000))) for k in range(4)]
    assert got(M.jaccard_classes(frame(spark, rows, "doc_id long, text string"))) == brute(rows)
    assert sum(made) == 0
