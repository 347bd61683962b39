from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest

from joblode.operators import keys
from joblode.session import shared_dir
from joblode.sources import idindex as I
from joblode.sources import tables as B


@pytest.fixture
def load(spark, tmp_path):
    """Loads ids on a day of March into one table."""
    path = str(tmp_path / "it's jobs")

    def run(day, *ids):
        rows = spark.createDataFrame([(i, f"{i}-{day}", n) for n, i in enumerate(ids)], "id string, title string, n int")
        return B.insert_jobs(spark, path, rows, as_of=datetime(2024, 3, day, 2), arrival=("n",)).inserted
    run.path = path
    return run


def stored(spark, path):
    return {r["id"]: r["title"] for r in B.read_jobs(spark, path).collect()}


@pytest.mark.parametrize("bound", [0, keys.BROADCAST_ROWS])
def test_same_rows_with_and_without_index(spark, load, monkeypatch, bound):
    monkeypatch.setattr(keys, "BROADCAST_ROWS", bound)
    assert load(1, "a", "b", "b", None) == 2
    I.build_index(spark, load.path, B.read_jobs(spark, load.path), buckets=4)
    I.build_index(spark, load.path, B.read_jobs(spark, load.path), buckets=8)  # there already
    assert I.index_buckets(spark, load.path) == 4
    assert load(2, "b", "c", None, "c", "") == 2
    assert load(3, *"abcd", "") == 1
    assert load(3, *"abcd", "") == 0
    assert stored(spark, load.path) == {"a": "a-1", "b": "b-1", "c": "c-2", "": "-2", "d": "d-3"}
    assert I.read_index(spark, load.path).count() == B.read_jobs(spark, load.path).count() == 5


def test_an_index_of_an_empty_table(spark, load, monkeypatch):
    monkeypatch.setattr(keys, "BROADCAST_ROWS", 0)
    I.build_index(spark, load.path, B.read_jobs(spark, load.path), buckets=2)
    assert load(1) == 0 and load(1, "a", "a") == 1 and load(2, "a", "b") == 1
    assert stored(spark, load.path) == {"a": "a-1", "b": "b-2"}


def test_folders_without_a_candidate_are_not_read(spark, load, monkeypatch):
    monkeypatch.setattr(keys, "BROADCAST_ROWS", 0)
    for day in range(1, 7):
        load(day, *(f"{day}-{n}" for n in range(20)))
    I.build_index(spark, load.path, B.read_jobs(spark, load.path), buckets=4)
    for part in Path(load.path).glob("*/*.parquet"):
        if part.parent.name not in ("scraped_on=2024-03-02", "scraped_on=2024-03-05"):
            part.write_bytes(b"not to be read")
    ids = spark.createDataFrame([("2-1",), ("5-7",), ("5-8",), ("new",), (None,)], "id string")
    with I.stored_among(spark, load.path, ids, B.read_jobs(spark, load.path)) as known:
        assert sorted(r["id"] for r in known.collect()) == ["2-1", "5-7", "5-8"]
    with I.stored_among(spark, load.path, ids.filter("id = 'new'"), B.read_jobs(spark, load.path)) as known:
        assert known.count() == 0


def test_the_index_is_not_shuffled(spark, load, plan):
    load(1, *(f"{n}" for n in range(50)))
    I.build_index(spark, load.path, B.read_jobs(spark, load.path), buckets=16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        days = I.found_days(spark, load.path, spark.range(40, 60).selectExpr("string(id) AS id"))
        text = plan(days)
        assert "Bucketed: true" in text
        index_side = text[text.index("SortMergeJoin"):].split("Exchange hashpartitioning(hash")
        assert len(index_side) == 2  # the batch's alone
        assert days.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_stopped_load_loses_nothing(spark, load, monkeypatch):
    monkeypatch.setattr(keys, "BROADCAST_ROWS", 0)
    load(1, "a")
    I.build_index(spark, load.path, B.read_jobs(spark, load.path), buckets=2)
    monkeypatch.setattr(B, "add_to_index", lambda *a: (I.add_to_index(*a), 1 / 0))  # indexed, not appended
    with pytest.raises(ZeroDivisionError):
        load(2, "a", "b")
    monkeypatch.setattr(B, "add_to_index", I.add_to_index)
    assert load(3, "a", "b") == 1
    assert stored(spark, load.path) == {"a": "a-1", "b": "b-3"}


def test_a_half_built_index_is_built_anew(spark, load):
    load(1, "a")
    I.build_index(spark, load.path, B.read_jobs(spark, load.path), buckets=2)
    files, mark = I.file_at(spark, f"{I._index_path(load.path)}/buckets-2/_SUCCESS")
    files.delete(mark, False)
    assert I.index_buckets(spark, load.path) is None
    I.build_index(spark, load.path, B.read_jobs(spark, load.path), buckets=2)
    assert I.read_index(spark, load.path).count() == 1


@pytest.mark.parametrize("master,named,warehouse,want", [
    ("local[4]", None, "file:/w", "file:/w/_scratch"), ("spark://h:7077", "/shared/", "/w", "/shared"),
    ("yarn", None, "hdfs://n/w/", "hdfs://n/w/_scratch"), ("yarn", None, "/w", None), ("yarn", None, "file:/w", None)])
def test_shared_folder(master, named, warehouse, want):
    held = {"spark.checkpoint.dir": named, "spark.sql.warehouse.dir": warehouse}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: held[key] or default),
                           sparkContext=SimpleNamespace(master=master))
    if want is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(fake)
    else:
        assert shared_dir(fake) == want
