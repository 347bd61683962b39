import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from joblode.operators import ann, knn
from joblode.operators.embed import embedding_width, hashing_embedder, model_embedder
from joblode.operators.vectors import build_vectors, hits_to_jobs, semantic_search_jobs
from joblode.sources.tables import read_vectors, upsert_vectors
from tests.test_tables import full_job

VECTORS = "vector_id string, job_id string, type string, embedding array<float>, metadata map<string,string>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(400, 12)).astype(np.float32)
    rows[100:240] = rows[100]  # a third of the vectors are copies
    rows[7] = 0
    return rows


@pytest.fixture(scope="module")
def vectors(spark, data):
    rows = [(f"v{i:03d}", str(i // 2), "full", list(map(float, r)), {"label": str(i % 3)})
            for i, r in enumerate(data)]
    return spark.createDataFrame(rows + [("none", "0", "full", None, {})], VECTORS).repartition(5)


def brute(data, query, k, keep=lambda i: True):
    def unit(m):
        n = np.linalg.norm(m, axis=-1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    scores = np.round(unit(data.astype(float)) @ unit(np.asarray(query, float)), 6)
    order = sorted((i for i in range(len(data)) if keep(i)), key=lambda i: (-scores[i], i))[:k]
    return [(f"v{i:03d}", float(scores[i])) for i in order]


def pairs(df):
    return [(r["vector_id"], r["score"]) for r in df.orderBy("rank").collect()]


def test_search(vectors, data):
    for q in (data[3], data[100], -data[100]):
        assert pairs(knn.search(vectors, list(q), 9)) == brute(data, q, 9)
    assert pairs(knn.search(vectors, list(data[3]), 4, where={"label": "1"})) == brute(
        data, data[3], 4, lambda i: i % 3 == 1)
    assert pairs(knn.search(vectors, list(data[3]), 4, where=F.col("job_id") < "2")) == brute(
        data, data[3], 4, lambda i: str(i // 2) < "2")
    assert knn.search(vectors, list(data[3]), 1000).count() == 400
    assert knn.search(vectors, list(data[3]), 0).count() == 0


def test_search_carries_no_pairs(vectors, data, plan):
    text = plan(knn.search(vectors, list(data[0]), 3))
    assert "TakeOrderedAndProject" in text and "CartesianProduct" not in text
    assert text.count("ArrowEvalPython") == 1 and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("bounds", [{}, {"shared_numbers": 240, "block_vectors": 64}])
def test_batch(spark, vectors, data, bounds):
    picks = [0, 3, 7, 100, 150, *range(300, 350)]
    queries = spark.createDataFrame([(i, list(map(float, data[i]))) for i in picks],
                                    "query_id long, embedding array<float>")
    rows = knn.search_batch(vectors, queries, 6, **bounds).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vector_id"], r["score"]))
    assert found == {i: brute(data, data[i], 6) for i in picks}
    none = queries.filter("query_id < 0")
    assert knn.search_batch(vectors, none, 6, **bounds).count() == 0


def test_wrong_width(vectors):
    with pytest.raises(Exception, match="wide"):
        knn.search(vectors, [1.0, 2.0], 3).collect()
    with pytest.raises(ValueError):
        knn.query_vector(vectors)


def test_pruned_search(spark, vectors, data, tmp_path, plan):
    planes = ann.hyperplanes(12, bits=4)
    path = str(tmp_path / "c")
    rows = vectors.withColumns({"field": F.lit(None).cast("string"), "document": F.lit("d")})
    upsert_vectors(spark, path, rows, planes=planes)
    # Loaded again with other vectors: each moves to its new cell and leaves the old one.
    upsert_vectors(spark, path, rows.withColumn("embedding", F.transform("embedding", lambda x: -x)), planes=planes)
    upsert_vectors(spark, path, rows, planes=planes)
    cells = read_vectors(spark, path)
    assert cells.count() == cells.select("vector_id").distinct().count() == 401
    hits = 0
    for i in range(250, 270):
        exact = {v for v, _ in brute(data, data[i], 5)}
        hits += len(exact & {v for v, _ in pairs(ann.search_cells(cells, planes, list(data[i]), 5))})
    assert hits >= 80  # of 100
    everything = ann.search_cells(cells, planes, list(data[3]), 9, flips=4)
    assert pairs(everything) == brute(data, data[3], 9)
    text = plan(ann.search_cells(cells, planes, list(data[3]), 9, flips=0))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", text)
    asked = spark.createDataFrame([(i, list(map(float, data[i]))) for i in (3, 7, 300)], "query_id long, embedding array<float>")
    found = ann.search_cells_batch(cells, planes, asked, 6, flips=4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vector_id"]) for r in found] == [
        (i, v) for i in (3, 7, 300) for v, _ in brute(data, data[i], 6)]
    with pytest.raises(ValueError):
        upsert_vectors(spark, path, rows)


def test_hashing_embedder(spark):
    df = spark.createDataFrame([("Python, python SQL",), ("sql PYTHON python",), ("  ",)], "document string")
    one, two, none = [r["embedding"] for r in hashing_embedder(64)(df).collect()]
    assert one == two and abs(sum(x * x for x in one) - 1) < 1e-6 and len(one) == 64
    assert not any(none)
    assert embedding_width(hashing_embedder(64)(df)).first().asDict() == {"min_width": 64, "max_width": 64}


def test_model_embedder(spark):
    def load():
        def model(texts):
            assert all(t == " " or t == t.strip() for t in texts)
            return [[len(t), 1] for t in texts]
        return model
    df = spark.createDataFrame([(" ab ",), ("",), (None,)], "document string")
    rows = [r["embedding"] for r in model_embedder(load)(df).collect()]
    assert rows == [[2.0, 1.0], [1.0, 1.0], [1.0, 1.0]]


def test_semantic_search(spark, plan):
    jobs = full_job(spark, ["1"], title="Python backend developer", role="Backend", skills_must=["python"],
                    description="fintech payments").unionByName(
        full_job(spark, ["2"], title="Accountant", role="Other", skills_must=["excel"],
                 description="books and taxes")).unionByName(
        full_job(spark, ["3"], title="Machine learning engineer", role="AI / ML", skills_must=["pytorch"],
                 description="models"))
    stored = build_vectors(jobs)
    for query, best in (("Find me Python backend developer jobs", "1"),
                        ("I'm a machine learning engineer", "3"), ("fintech startups", "1")):
        rows = semantic_search_jobs(jobs, stored, query, 5).collect()
        assert rows[0]["id"] == best and len(rows) == 5
        scores = [r["score"] for r in rows]
        assert scores == sorted(scores, reverse=True)
        once = [r["id"] for r in semantic_search_jobs(jobs, stored, query, 5, distinct_jobs=True).collect()]
        assert once[0] == best and sorted(once) == ["1", "2", "3"]
    assert semantic_search_jobs(jobs, stored, "  ", 2).count() == 2
    full = semantic_search_jobs(jobs, stored, "python", 2, where={"type": "full"})
    assert full.first()["id"] == "1"
    assert "BroadcastHashJoin" in plan(full)


def test_hits_keep_rank_and_repeats(spark):
    hits = spark.createDataFrame([("a", 1, .9), ("b", 2, .8), ("a", 3, .7), ("z", 4, .6)],
                                 "job_id string, rank int, score double")
    jobs = spark.createDataFrame([("b",), ("a",)], "id string")
    assert [r["id"] for r in hits_to_jobs(hits, jobs, ("id",)).collect()] == ["a", "b", "a"]


@pytest.mark.parametrize("bits", [3, 4, 5, 6, 7, 8])
def test_default_flips_reach_nine_of_ten(bits):
    """On the given vectors, every fiftieth asked for its ten nearest."""
    import pyarrow.parquet as pq

    rows = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["embedding"])["embedding"].to_pylist(), float)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    sides = unit @ np.array(ann.hyperplanes(rows.shape[1], bits)).T >= 0
    near = (sides[::50, None, :] != sides[None]).sum(axis=2) <= ann.default_flips(bits)
    nearest = np.argsort(-(unit[::50] @ unit.T), axis=1)[:, :10]
    assert np.take_along_axis(near, nearest, axis=1).mean() >= 0.9


def test_copies_of_rows_do_not_grow_with_the_table():
    """Each row goes to so many blocks; the groups stay bounded."""
    for rows in (10_256, 102_564, 615_384):
        q, v = knn._block_counts(rows, rows, 64, 1 << 13, 1 << 11, 12)
        assert q + v <= 20 and q * v >= 12
        assert max(-(-rows // q), -(-rows // v)) * 64 <= knn.HELD_NUMBERS + 64
    q, v = knn._block_counts(10**7, 10**7, 64, 1 << 13, 1 << 11, 12)
    assert max(-(-10**7 // q), -(-10**7 // v)) * 64 <= knn.HELD_NUMBERS + 64


@pytest.mark.parametrize("width", [3, 384])
def test_scorer_is_exact(width):
    """Close scores, ties, copies, vectors without length and several tiles, against a whole product in double precision."""
    import pyarrow as pa

    rng = np.random.default_rng(width)
    given = rng.normal(size=(2500, width)).astype(np.float32)
    given[500:1200] = given[500]
    given[1200:1900] = given[1200] + rng.normal(size=(700, width)).astype(np.float32) * 1e-3
    given[7:20] = 0
    place = rng.permutation(2500)

    def lists(rows):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel()))

    names = np.array([f"v{i:04d}" for i in place])
    asked = pa.table({"query_id": pa.array(range(2500), pa.int64()), "embedding": lists(given)})
    whole = np.array([f"v{i:04d}" for i in range(2500)])
    norms = np.linalg.norm(given.astype(float), axis=1, keepdims=True)
    unit_ = np.divide(given.astype(float), norms, out=np.zeros((2500, width)), where=norms > 0)
    for distinct in (False, True):
        start, add, result = knn._scorer(6, pa.string())
        best = start(asked, distinct)
        for at in range(0, 2500, 900):
            add(best, pa.array(names[at:at + 900]), lists(given[place][at:at + 900]))
        found = result(asked, best).to_pydict()
        assert found["query_id"] == sorted(list(range(2500)) * 6)
        for i in [*range(0, 2500, 101), 7, 8, 500, 501, 1200, 1201]:
            scores = np.round(unit_ @ unit_[i], 6)
            order = np.lexsort((whole, -scores))[:6]
            got = [(found["vector_id"][6 * i + j], found["score"][6 * i + j]) for j in range(6)]
            assert sorted(got, key=lambda p: (-p[1], p[0])) == [(whole[j], scores[j]) for j in order], i


def test_one_query_in_slices(spark, vectors, data, monkeypatch):
    """A batch is scored slice by slice, nulls and vectors without length among them."""
    monkeypatch.setattr(knn, "ONE_SLICE", 7)
    found = knn.search(vectors.coalesce(1), list(data[3]), 12)
    assert pairs(found) == brute(data, data[3], 12)
