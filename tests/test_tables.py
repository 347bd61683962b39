from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from joblode.operators import keys
from joblode.operators.aggregates import count_jobs_on
from joblode.operators.vectors import build_vectors, missing_vectors, vector_texts
from joblode.schemas import JOBS_SCHEMA, STUB_SCHEMA, VECTOR_SCHEMA
from joblode.session import spread, staged
from joblode.sources import stages as G
from joblode.sources import tables as B

NOW = datetime(2024, 3, 10, 2)


def incoming(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, n int")


def test_insert_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "jobs")
    assert B.read_jobs(spark, path).count() == 0
    one = B.insert_jobs(spark, path, incoming(spark, [("a", "a", 0), ("b", "b1", 1)]), as_of=NOW)
    two = B.insert_jobs(spark, path, incoming(spark, [("b", "b2", 0), ("c", "c2", 2), ("c", "c1", 1),
                                                      (None, "x", 3)]), as_of=NOW, arrival=("n",))
    assert (one.sent, one.inserted, two.sent, two.inserted) == (2, 2, 4, 1)
    rows = {r["id"]: r for r in B.read_jobs(spark, path).collect()}
    assert {k: r["title"] for k, r in rows.items()} == {"a": "a", "b": "b1", "c": "c1"}
    assert rows["a"]["source"] == "linkedin" and rows["a"]["scraped_at"] == NOW


def test_one_id_may_be_a_third_of_a_batch(spark, tmp_path):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").cast("int").alias("n"))
    counts = B.insert_jobs(spark, str(tmp_path / "j"), rows, as_of=NOW, arrival=("n",))
    assert (counts.sent, counts.inserted) == (9000, 6001)


def test_day_count_reads_one_folder(spark, tmp_path, plan):
    path = str(tmp_path / "jobs")
    for day in (8, 9, 9, 10):
        B.insert_jobs(spark, path, incoming(spark, [(f"{day}-{datetime.now().timestamp()}", "t", 0)]),
                      as_of=datetime(2024, 3, day, 23, 59))
    df = count_jobs_on(B.read_jobs(spark, path), date(2024, 3, 9))
    assert df.first()["n"] == 2
    assert "PartitionFilters: [isnotnull(scraped_on" in plan(df)


def test_catalog_table(spark, tmp_path):
    B.create_jobs_table(spark, "jobs_of_test", str(tmp_path / "t"))
    B.create_jobs_table(spark, "jobs_of_test", str(tmp_path / "t"))
    assert spark.table("jobs_of_test").columns[:-1] == JOBS_SCHEMA.names
    spark.sql("DROP TABLE jobs_of_test")


def full_job(spark, ids, **changes):
    base = dict(title="T", role="R", seniority="Mid", company="C", location="L", url="u",
                description=" d ", skills_must=["x", "", None, "y"], skills_nice=["z"],
                yearsexperience=3, past_experience=["p"], keyword="k", source="s",
                posted_at=date(2024, 1, 1), scraped_at=NOW) | changes
    return spark.createDataFrame([tuple((dict(base, id=i))[c] for c in JOBS_SCHEMA.names) for i in ids],
                                 JOBS_SCHEMA)


def test_vector_rows(spark):
    rows = vector_texts(full_job(spark, ["1"])).collect()
    assert len(rows) == 8 and len({r["vector_id"] for r in rows}) == 8
    by = {r["field"] or "full": r for r in rows}
    assert by["skills_must"]["document"] == "x, y" and by["description"]["document"] == "d"
    assert by["full"]["document"].startswith("Job Title: T\nRole: R\n")
    assert by["full"]["metadata"]["skills_must"] == "x, , None, y"
    assert by["title"]["metadata"]["field"] == "title" and "field" not in by["full"]["metadata"]
    assert len(vector_texts(full_job(spark, ["1"], skills_nice=[])).collect()) == 7
    bare = vector_texts(full_job(spark, ["1"], role=None, yearsexperience=None, description=None,
                                 skills_must=None)).collect()
    text = next(r["document"] for r in bare if r["type"] == "full")
    assert "Role: None\n" in text and "Experience: None years" in text and text.endswith("None")
    assert "Required Skills: \n" in text


def test_upsert_and_backfill(spark, tmp_path):
    path = str(tmp_path / "v")
    jobs = full_job(spark, ["a", "b_c"])
    first = B.upsert_vectors(spark, path, build_vectors(jobs.filter("id = 'a'")), buckets=4)
    assert (first.sent, first.inserted) == (8, 8)
    stored = B.read_vectors(spark, path)
    assert [r["id"] for r in missing_vectors(jobs, stored).collect()] == ["b_c"]
    changed = build_vectors(full_job(spark, ["a", "b_c"], title="New", skills_nice=[]))
    second = B.upsert_vectors(spark, path, changed, buckets=4)
    assert (second.sent, second.inserted) == (14, 7)
    rows = B.read_vectors(spark, path).select("vector_id", "document").collect()
    texts = {r["vector_id"]: r["document"] for r in rows}
    assert len(rows) == len(texts) == 15
    # A vector whose field became empty stays as it was.
    assert texts["a_title"] == "New" and texts["a_skills_nice"] == "z"
    assert missing_vectors(jobs, B.read_vectors(spark, path)).count() == 0


def test_folders_are_kept(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = build_vectors(full_job(spark, ["a", "b"]))
    B.upsert_vectors(spark, path, rows)
    with pytest.raises(ValueError):
        B.upsert_vectors(spark, path, rows, buckets=8)
    assert B.upsert_vectors(spark, path, rows).inserted == 0
    assert B.read_vectors(spark, path).count() == 16


def test_last_vector_wins(spark, tmp_path):
    path = str(tmp_path / "v")
    row = build_vectors(full_job(spark, ["a"])).filter("type = 'full'")
    said = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("t"))
                               for n, t in enumerate(("zeta first", "alpha", "middle last"))]))
    rows = row.withColumn("s", said).withColumns({"document": F.col("s.t"), "seen": F.col("s.n")})
    B.upsert_vectors(spark, path, rows, arrival=("seen",))
    assert [r["document"] for r in B.read_vectors(spark, path).collect()] == ["middle last"]


def test_only_ids_are_compared(spark, plan):
    """Descriptions take no part in finding the postings without a vector."""
    jobs = full_job(spark, ["a", "b"])
    text = plan(missing_vectors(jobs, build_vectors(jobs.filter("id = 'a'"))))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_catalog_table_shows_loads(spark, tmp_path):
    B.create_jobs_table(spark, "shown_jobs", str(tmp_path / "t"))
    B.insert_into_catalog(spark, "shown_jobs", full_job(spark, ["a", "b"]), as_of=NOW)
    assert {r["id"] for r in spark.table("shown_jobs").collect()} == {"a", "b"}
    spark.sql("DROP TABLE shown_jobs")


def test_stage(spark, tmp_path):
    path = G.stage_path(str(tmp_path), "manual__2024-03-10T02:00:00+00:00", "stubs")
    assert path.endswith("manual__2024-03-10T02_00_00_00_00_stubs")
    row = ("1", "כותרת", None, "L", "u", "d", "2024-01-01", "k", 0, 1, 2)
    G.write_stage(spark.createDataFrame([row], STUB_SCHEMA), path)
    assert tuple(G.read_stage(spark, path, STUB_SCHEMA).first()) == row


def test_staged_cuts_lineage(spark, plan):
    df = staged(spark.range(5).withColumn("r", F.rand()), "t")
    assert df.collect() == df.collect() and "Range" not in plan(df)


def test_spread_leaves_many_partitions_alone(spark, plan):
    assert "RoundRobin" not in plan(spread(spark.range(0, 100, 1, 64)))
    assert "RoundRobin" in plan(spread(spark.range(0, 100, 1, 1)))


def test_vectors_leave_a_cell_empty(spark, tmp_path):
    """The only vector of a cell moves to another one; one without an embedding gets one."""
    path, planes = str(tmp_path / "v"), [[1.0, 0.0], [0.0, 1.0]]
    row = build_vectors(full_job(spark, ["a", "b"])).filter("type = 'full'").drop("embedding")
    at = lambda a, b: row.withColumn("embedding", F.when(F.col("job_id") == "a", F.lit(a)).otherwise(F.lit(b)).cast("array<float>"))
    for a, b in (([1.0, 1.0], None), ([-1.0, -1.0], [1.0, -1.0]), ([1.0, -1.0], [1.0, -1.0])):
        B.upsert_vectors(spark, path, at(a, b), unique=True, planes=planes)
        stored = {(r["vector_id"], tuple(r["embedding"] or ())) for r in B.read_vectors(spark, path).collect()}
        assert B.read_vectors(spark, path).count() == 2
        assert stored == {("a_full", tuple(a)), ("b_full", tuple(b or ()))}


def test_stopped_upsert(spark, tmp_path, monkeypatch):
    """An upsert that stops at any step leaves the old state or the new one, and the next one mends it."""
    path = str(tmp_path / "vectors")

    def at(text, *ids):
        return spark.createDataFrame([(i, i, "full", None, text, [1.0], {}) for i in ids], VECTOR_SCHEMA)

    def now():
        return {r["vector_id"]: r["document"] for r in B.read_vectors(spark, path).collect()}

    def stops(name, before):
        kept = getattr(B, name)

        def stop(*a):
            if not before:
                kept(*a)
            raise OSError(name)
        monkeypatch.setattr(B, name, stop)
        with pytest.raises(OSError):
            B.upsert_vectors(spark, path, at("new", "a", "c"), buckets=2)
        monkeypatch.setattr(B, name, kept)
        assert B.read_vectors(spark, path).count() == len(now())

    B.upsert_vectors(spark, path, at("old", "a", "b"), buckets=2)
    held = B.read_vectors(spark, path)
    stops("_commit", before=True)
    assert now() == {"a": "old", "b": "old"}
    stops("_commit", before=False)
    assert now() == {"a": "new", "b": "old", "c": "new"}
    stops("_drop_old", before=True)
    assert now() == {"a": "new", "b": "old", "c": "new"}
    B.upsert_vectors(spark, path, at("newer", "a"), buckets=2)
    assert now() == {"a": "newer", "b": "old", "c": "new"}
    assert len([p for p in (tmp_path / "vectors" / "manifests").iterdir() if p.suffix == ".json"]) == B.KEPT_VERSIONS
    # The state of one version before can be read still; two writers of one version: the second is told.
    B.upsert_vectors(spark, path, at("last", "b"), buckets=2)
    number, folders = B._manifest(spark, path)
    with pytest.raises(RuntimeError):
        B._commit(spark, path, number, folders)
    assert now() == {"a": "newer", "b": "last", "c": "new"} and held.schema == B.read_vectors(spark, path).schema


def test_built_vectors_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Vectors are built where they are written: once, after their postings were dealt out, and staged nowhere."""
    path, jobs, copies = str(tmp_path / "v"), full_job(spark, [f"{n}" for n in range(40)]), []
    monkeypatch.setattr(B, "stage", lambda df, name: copies.append(name))
    plans = []

    def build(rows):
        plans.append(build_vectors(rows)._jdf.queryExecution().optimizedPlan().toString())
        return build_vectors(rows)
    assert B.upsert_vectors(spark, path, jobs, build=build) == B.LoadCounts(320, 320)
    assert not copies and len(plans) == 1 and plans[0].index("Generate") < plans[0].index("Rebalance")
    assert {r["vector_id"]: r["embedding"] for r in B.read_vectors(spark, path).collect()} == {
        r["vector_id"]: r["embedding"] for r in build_vectors(jobs).collect()}


@pytest.mark.parametrize("bound", [0, keys.BROADCAST_ROWS])
def test_built_vectors_replace_stored_ones(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(keys, "BROADCAST_ROWS", bound)
    path = str(tmp_path / "v")
    build = build_vectors
    assert B.upsert_vectors(spark, path, full_job(spark, []), build=build) == B.LoadCounts(0, 0)
    B.upsert_vectors(spark, path, full_job(spark, [f"{n}" for n in range(100)]), build=build)
    B.upsert_vectors(spark, path, build_vectors(full_job(spark, ["x"])).filter("type = 'field'"), unique=True)
    # One vector id of "x" and all of "7" are stored; "x_role" is not built anew and stays.
    again = B.upsert_vectors(spark, path, full_job(spark, ["7", "x", "y"], title="New", role=None), build=build)
    assert again == B.LoadCounts(21, 21 - 7 - 6)
    rows = B.read_vectors(spark, path).select("vector_id", "document").collect()
    texts = {r["vector_id"]: r["document"] for r in rows}
    assert len(rows) == len(texts) == 100 * 8 + 8 + 7
    assert [texts[i] for i in ("7_title", "x_title", "y_title", "8_title", "x_role", "7_role")] == ["New"] * 3 + ["T", "R", "R"]


@pytest.mark.parametrize("bound", [0, keys.BROADCAST_ROWS])
def test_postings_meet_by_their_ids(spark, tmp_path, monkeypatch, bound):
    """Rows whose id comes once are not ranked, and none is compared with the stored postings but by its id."""
    monkeypatch.setattr(keys, "BROADCAST_ROWS", bound)
    ranked, inner = [], keys.first_by
    monkeypatch.setattr(keys, "first_by", lambda df, *a: (ranked.append(df.count()), inner(df, *a))[1])
    path = str(tmp_path / "j")
    B.insert_jobs(spark, path, incoming(spark, [("a", "old", 0)]), as_of=NOW)
    ranked.clear()
    rows = [(f"{n}", "t", 1) for n in range(50)] + [("a", "new", 0), ("b", "b2", 2), ("b", "b1", 1), (None, "x", 0), (None, "x", 0)]
    assert B.insert_jobs(spark, path, incoming(spark, rows), as_of=NOW, arrival=("n",)) == B.LoadCounts(55, 51)
    stored = {r["id"]: r["title"] for r in B.read_jobs(spark, path).collect()}
    assert len(stored) == 52 and (stored["a"], stored["b"]) == ("old", "b1")
    assert bound == 0 or ranked == [2]
