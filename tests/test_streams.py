from datetime import datetime

from joblode.sources import tables as B
from joblode.streaming.ingest import distinct_stream, ingest_stream

NOW = datetime(2024, 3, 10, 2)
SCHEMA = "id string, title string, n int"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(folder)


def test_ingest(spark, tmp_path):
    source, jobs, vectors = (str(tmp_path / n) for n in ("in", "jobs", "vectors"))

    def run(checkpoint="cp", **more):
        stream = spark.readStream.schema(SCHEMA).json(source)
        ingest_stream(stream, jobs, str(tmp_path / checkpoint), as_of=lambda: NOW, arrival=("n",),
                      **more).awaitTermination()
        return {r["id"]: r["title"] for r in B.read_jobs(spark, jobs).collect()}

    write(spark, source, [("a", "a2", 2), ("a", "a1", 1), ("b", "b", 3)])
    assert run() == {"a": "a1", "b": "b"}
    write(spark, source, [("b", "later", 4), ("c", "c", 5)])
    assert run(vectors_path=vectors) == {"a": "a1", "b": "b", "c": "c"}
    assert B.read_jobs(spark, jobs).count() == 3
    assert run("lost") == {"a": "a1", "b": "b", "c": "c"}  # the same files delivered again
    full = B.read_vectors(spark, vectors).filter("type = 'full'")
    assert sorted(r["job_id"] for r in full.collect()) == ["a", "b", "c"]
    write(spark, source, [(f"d{i}", "d", i) for i in range(9)])
    assert set(run(daily_target=5)) == {"a", "b", "c", "d0", "d1"}
    assert len(run("lost2", daily_target=5)) == 5


def test_distinct(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("a", datetime(2024, 3, 1, 1)), ("a", datetime(2024, 3, 1, 2)), ("b", datetime(2024, 3, 1, 3))]
    schema = "id string, ts timestamp"
    for _ in range(2):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = distinct_stream(spark.readStream.schema(schema).parquet(source), "ts")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_catch_up(spark, tmp_path, monkeypatch):
    """Vectors of all pending postings, whatever was stopped: after the insert, or after the vectors were written."""
    from joblode.plans import ingest as P
    jobs, vectors = str(tmp_path / "jobs"), str(tmp_path / "vectors")

    def rows(*ids):
        return spark.createDataFrame([(i, i) for i in ids], "id string, title string")

    def built():
        return sorted(r["job_id"] for r in B.read_vectors(spark, vectors).filter("type = 'full'").collect())

    B.insert_jobs(spark, jobs, rows("old"), as_of=NOW)  # from before the log
    B.insert_jobs(spark, jobs, rows("a", "b"), as_of=NOW, pending=True)
    P.load_pending_vectors(spark, jobs, vectors)
    assert built() == ["a", "b", "old"]
    # Logged but never inserted: the next batch of the same rows inserts them.
    B._log_pending(spark, jobs, B.conform_jobs(rows("c"), NOW))
    P.load_pending_vectors(spark, jobs, vectors)
    B.insert_jobs(spark, jobs, rows("c"), as_of=NOW, pending=True)
    # Stopped after the vectors were written, before the log was cleared.
    def stop(*a, **k):  # noqa: E306
        P_upsert(*a, **k)
        raise RuntimeError("stopped")
    P_upsert = P.upsert_vectors
    monkeypatch.setattr(P, "upsert_vectors", stop)
    try:
        P.load_pending_vectors(spark, jobs, vectors)
    except RuntimeError:
        pass
    monkeypatch.setattr(P, "upsert_vectors", P_upsert)
    with B.pending_vectors(spark, jobs) as left:
        assert [r["id"] for r in left.collect()] == ["c"]
        B._log_pending(spark, jobs, B.conform_jobs(rows("c"), NOW))  # logged meanwhile: not struck off
    assert P.load_pending_vectors(spark, jobs, vectors).inserted == 0
    assert built() == ["a", "b", "c", "old"]
    with B.pending_vectors(spark, jobs) as left:
        assert left.count() == 0
