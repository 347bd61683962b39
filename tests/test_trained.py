import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from joblode.operators import ann, knn
from joblode.operators.trained import TrainedCells, measured_probes, train_cells
from joblode.sources.tables import read_vectors, upsert_vectors

VECTORS = ("vector_id string, job_id string, type string, field string, document string, metadata map<string,string>, "
           "embedding array<float>")
WIDTH, COUNT = 16, 900


@pytest.fixture(scope="module")
def data():
    """Vectors around thirty directions; a third of them are copies of one, one has no length."""
    rng = np.random.default_rng(11)
    about = rng.normal(size=(30, WIDTH)) * 3
    rows = (about[rng.integers(0, 30, COUNT)] + rng.normal(size=(COUNT, WIDTH))).astype(np.float32)
    rows[300:600] = rows[300]
    rows[7] = 0
    return rows


@pytest.fixture(scope="module")
def vectors(spark, data):
    rows = [(f"v{i:03d}", str(i), "full", None, "d", {}, list(map(float, r))) for i, r in enumerate(data)]
    return spark.createDataFrame([*rows, ("none", "x", "full", None, "d", {}, None)], VECTORS).repartition(5)


@pytest.fixture(scope="module")
def cells(vectors):
    return train_cells(vectors, 24)


@pytest.fixture(scope="module")
def stored(spark, vectors, cells, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trained") / "t")
    upsert_vectors(spark, path, vectors, planes=cells)
    return read_vectors(spark, path)


def unit(m):
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def brute(data, query, k, among):
    scores = np.round(unit(data.astype(float)) @ unit(np.asarray(query, float)), 6)
    order = sorted(among, key=lambda i: (-scores[i], i))[:k]
    return [(f"v{i:03d}", float(scores[i])) for i in order]


def by_query(rows):
    found = {}
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vector_id"], r["score"]))
    return found


def asked(spark, data, picks):
    return spark.createDataFrame([(i, list(map(float, data[i]))) for i in picks], "query_id long, embedding array<float>")


def test_cells(stored, data, cells):
    assert np.allclose(np.linalg.norm(cells.centroids, axis=1), 1)
    homes = (data.astype(float) @ cells.centroids.T).argmax(axis=1)
    held = {r["vector_id"]: r["bucket"] for r in stored.select("vector_id", "bucket").collect()}
    assert held == {"none": None, **{f"v{i:03d}": int(h) for i, h in enumerate(homes)}}
    assert stored.filter(F.col("vector_id").isin("v300", "v450", "v599")).select("bucket").distinct().count() == 1


@pytest.mark.parametrize("bounds", [{}, {"shared_numbers": 8 * WIDTH, "block_vectors": 20}])
@pytest.mark.parametrize("probes", [1, 4, None, 24])
def test_batch_is_exact_within_the_cells(spark, stored, data, cells, bounds, probes):
    picks = [0, 3, 7, 300, 450, *range(610, 640)]
    found = by_query(ann.search_cells_batch(stored, cells, asked(spark, data, picks), 6, probes, **bounds))
    homes = (data.astype(float) @ cells.centroids.T).argmax(axis=1)
    for i in picks:
        near = set(cells.order(data[i])[:cells.probes if probes is None else probes])
        among = [j for j in range(COUNT) if homes[j] in near]
        assert found[i] == brute(data, data[i], 6, among), i


@pytest.mark.parametrize("bounds", [{}, {"shared_numbers": 40, "block_vectors": 30}])
def test_groups(spark, vectors, data, bounds):
    """A query meets its own groups only: one without groups finds nothing, a group without vectors adds nothing."""
    grouped = vectors.withColumn("group", F.when(F.col("job_id") == "x", None).otherwise(F.expr("try_cast(job_id AS int) % 3")))
    queries = asked(spark, data, [1, 2, 3, 4]).withColumn("groups", F.expr(
        "CASE query_id WHEN 1 THEN array(0) WHEN 2 THEN array(2, 0) WHEN 3 THEN array(1, 99) ELSE array() END"))
    found = by_query(knn.search_grouped(grouped, queries, 5, **bounds))
    groups = {1: {0}, 2: {0, 2}, 3: {1}}
    assert found == {q: brute(data, data[q], 5, [i for i in range(COUNT) if i % 3 in g]) for q, g in groups.items()}
    assert knn.search_grouped(grouped, queries.filter("query_id > 9"), 5, **bounds).count() == 0
    assert knn.search_grouped(grouped.limit(0), queries, 5, **bounds).count() == 0


def test_no_pairs_in_the_plan(spark, stored, data, cells, plan):
    some = asked(spark, data, range(20))
    shared = plan(ann.search_cells_batch(stored, cells, some, 6, 2))
    assert "MapInArrow" in shared and "Join" not in shared
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", shared)
    blocks = plan(ann.search_cells_batch(stored, cells, some, 6, 2, shared_numbers=8, block_vectors=20))
    assert "FlatMapCoGroupsInArrow" in blocks
    assert not re.search("SortMergeJoin|CartesianProduct|NestedLoop", blocks)


def test_recall_at_the_default(spark, stored, data, cells):
    picks = [i for i in range(COUNT) if i % 20 == 0]
    found = by_query(ann.search_cells_batch(stored, cells, asked(spark, data, picks), 10))
    exact = {i: {v for v, _ in brute(data, data[i], 10, range(COUNT))} for i in picks}
    assert sum(len(exact[i] & {v for v, _ in found[i]}) for i in picks) >= 0.9 * 10 * len(picks)
    assert cells.probes < len(cells) / 2


def test_one_query(spark, stored, data, cells, plan):
    everything = ann.search_cells(stored, cells, list(map(float, data[3])), 9, flips=len(cells))
    assert [(r["vector_id"], r["score"]) for r in everything.orderBy("rank").collect()] == brute(data, data[3], 9, range(COUNT))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan(ann.search_cells(stored, cells, list(map(float, data[3])), 9)))


def test_measured_probes(spark, vectors, data, cells):
    """The fewest cells that hold the share, against a count by hand."""
    picks = [1, 5, 9, 310, 700, 800]
    queries = spark.createDataFrame([(f"v{i:03d}", list(map(float, data[i]))) for i in picks], "query_id string, embedding array<float>")
    homes = (data.astype(float) @ cells.centroids.T).argmax(axis=1)
    places = []
    for i in picks:
        order = cells.order(data[i])
        places += [order.index(homes[int(v[1:])]) for v, _ in brute(data, data[i], 11, range(COUNT)) if int(v[1:]) != i]
    for share in (0.5, 0.9, 1.0):
        got = measured_probes(vectors, cells, queries, share, 10)
        assert np.mean(np.array(places) < got) >= share and (got == 1 or np.mean(np.array(places) < got - 1) < share)
    assert measured_probes(vectors, cells, queries.limit(0)) == len(cells)


def test_saved_cells(spark, vectors, cells, tmp_path):
    cells.save(spark, str(tmp_path / "cells"))
    again = TrainedCells.read(spark, str(tmp_path / "cells"))
    assert again.name == cells.name and again.probes == cells.probes and (again.centroids == cells.centroids).all()
    table = str(tmp_path / "t")
    upsert_vectors(spark, table, vectors, planes=cells)
    # Loaded again with other vectors, by the cells that were read: each moves to its new cell.
    upsert_vectors(spark, table, vectors.withColumn("embedding", F.transform("embedding", lambda x: -x)), planes=again)
    rows = read_vectors(spark, table)
    assert rows.count() == rows.select("vector_id").distinct().count() == COUNT + 1
    assert rows.filter(F.col("bucket") != again.cell_of("embedding")).count() == 0
    with pytest.raises(ValueError):
        upsert_vectors(spark, table, vectors, planes=TrainedCells(cells.centroids[::-1], 1))


def test_odd_tables(spark, vectors):
    with pytest.raises(ValueError):
        train_cells(vectors.limit(0))
    alike = vectors.filter("vector_id between 'v300' and 'v599'")
    same = train_cells(alike, 8)
    assert same.probes == 1 and len(same) <= 8
    assert len(train_cells(vectors.filter("vector_id = 'v001'"))) >= 1


def test_recall_joins_what_is_written(spark, stored, data, cells, plan):
    """No search runs beside the broadcasts of the joins, which would wait for its tasks and run out of time."""
    from workload.search import _recall

    found = _recall(stored, cells, asked(spark, data, [1, 310, 700]))
    assert not re.search("MapInArrow|FlatMapCoGroups|ArrowEvalPython", plan(found))
    rows = {r["query_id"]: r for r in found.collect()}
    assert set(rows) == {1, 310, 700} and all(r["exact"] == 10 and r["rows"] == COUNT + 1 for r in rows.values())
    homes = (data.astype(float) @ cells.centroids.T).argmax(axis=1)
    for i, r in rows.items():
        near = set(cells.order(data[i])[:cells.probes])
        among = [j for j in range(COUNT) if homes[j] in near]
        assert r["rows_read"] == len(among)
        assert r["found"] == len({v for v, _ in brute(data, data[i], 10, among)} & {v for v, _ in brute(data, data[i], 10, range(COUNT))})


def test_bundles_hold_every_group():
    """Small groups share a block, a large one has blocks of its own, and blocks are as few as were asked for."""
    made = knn._bundles({5: 1, 1: 100, 2: 3, 9: 4, 7: 250}, 4)
    spans = {g: range(f, f + p) for g, f, p in zip(made["group"], made["first"], made["parts"])}
    assert list(spans) == [1, 2, 5, 7, 9] and len(spans[7]) == 3 and len(spans[1]) == 2
    assert spans[2] == spans[5] and not set(spans[7]) & set(spans[9]) and not set(spans[7]) & set(spans[5])
    many = knn._bundles(dict.fromkeys(range(784), 784), 7)
    assert len(set(many["first"])) <= 8 and set(many["parts"]) == {1}


def test_a_query_goes_once_to_a_block(spark, vectors, data, plan):
    """All groups asked for: rows sent to blocks are a few for each row, not one for each group."""
    grouped = vectors.withColumn("group", F.expr("try_cast(job_id AS int) % 90"))
    queries = asked(spark, data, range(200)).withColumn("groups", F.expr("sequence(0, 89)").cast("array<int>"))
    found = knn.search_grouped(grouped, queries, 5, shared_numbers=WIDTH, block_vectors=10)
    assert by_query(found) == {i: brute(data, data[i], 5, range(COUNT)) for i in range(200)}
    assert "FlatMapCoGroupsInArrow" in plan(found)
    q, v = knn._block_counts(200, COUNT, WIDTH, WIDTH, 10, spark.sparkContext.defaultParallelism)
    assert q + v <= 2 + 2 * knn.GROUPS_PER_CORE * spark.sparkContext.defaultParallelism
