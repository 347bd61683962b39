import random

import pytest

from joblode.operators.keys import first_by, rows_with_ids, take_first, unknown_rows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 5 + [f"k{i}" for i in range(10)]), rng.randrange(4),
             rng.randrange(3), rng.randrange(6), i) for i in range(600)]
    return data, spark.createDataFrame(data, "id string, a int, b int, c int, n int").repartition(8)


def test_first_by_limits_before_the_shuffle(rows, plan):
    data, df = rows
    want = {}
    for r in sorted(data, key=lambda r: (r[1], r[2], r[3], r[4])):
        want.setdefault(r[0], r)
    first = first_by(df, ["id"], ["a", "b", "c", "n"])
    assert {r["id"]: tuple(r) for r in first.collect()} == want
    text = plan(first_by(df, ["id"], ["a", "b", "c", "n"]))
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


@pytest.mark.parametrize("n", [-1, 0, 1, 5, 17, 150, 151, 599, 600, 601])
def test_cut_by_ranges_equals_sorted_cut(rows, n):
    data, df = rows
    want = sorted(r[4] for r in sorted(data, key=lambda r: r[1:])[:max(n, 0)])
    order = ["a", "b", "c", "n"]
    assert sorted(r["n"] for r in take_first(df, order, n, top_rows=3).collect()) == want
    assert sorted(r["n"] for r in take_first(df, order, n).collect()) == want


@pytest.mark.parametrize("small", [False, True])
def test_unknown_rows(spark, rows, small, plan):
    _, df = rows
    known = spark.createDataFrame([("hot", 1), ("k3", 1)], "id string, x int")
    left = unknown_rows(df, known, small_batch=small)
    assert {r["id"] for r in left.select("id").distinct().collect()} == {
        f"k{i}" for i in range(10) if i != 3}
    text = plan(left)
    assert "LeftAnti" in text and "CartesianProduct" not in text
    assert ("LeftSemi" in text) == small


def test_rows_with_ids(spark, rows):
    _, df = rows
    assert rows_with_ids(df, ["k1"]).select("id").distinct().count() == 1
    assert rows_with_ids(df, []).count() == 0
