import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from joblode.llm import curve
from tests.llm.conftest import TEXTS


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_each_cell_once_and_by_single_steps(spark, dims, bits):
    names = [f"d{k}" for k in range(dims)]
    cells = list(product(range(2**bits), repeat=dims))
    df = spark.createDataFrame([(*c, *c) for c in cells], ", ".join(f"{n} int" for n in [*names, *[f"c{n}" for n in names]]))
    got = sorted(curve.hilbert_index(df, names, bits, "at").collect(), key=lambda r: r["at"])
    assert [r["at"] for r in got] == list(range(len(cells)))
    for a, b in zip(got, got[1:]):
        assert sum(abs(a[f"c{n}"] - b[f"c{n}"]) for n in names) == 1


def law(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_even_runs(small, shards):
    rows = curve.curve_shards(small, ["lang", "source", "size"], shards).collect()
    assert len(rows) == small.count()
    law(rows, shards)
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_odd(odd, empty):
    rows = curve.curve_shards(odd, ["lang", "source", "size"], 7, bits=3).collect()
    law(rows, 7)
    want = sorted(str((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in TEXTS)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in rows) == want
    assert curve.curve_shards(empty, ["lang", "size"], 3).count() == 0


def test_shards_can_be_skipped(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = curve.curve_shards(docs, ["lang", "source", "size"], 24)
    curve.write_shards(docs, placed, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == docs.count() and set(docs.columns) < set(out.columns)
    spans = out.groupBy("shard").agg(F.collect_set("lang").alias("langs"), F.min("n_chars").alias("low"),
                                     F.max("n_chars").alias("high")).collect()
    # A reader of one language skips most shards, and so does one of short texts.
    assert sum("de" in r.langs for r in spans) <= 12
    assert sum(r.low <= 300 for r in spans) <= 20


def test_strings_are_cut_by_rank(spark):
    """Values that differ after a long common prefix are told apart, a hot one takes its share of the axis."""
    values = [f"https://example.org/a/very/long/prefix/{i % 61:03d}" for i in range(700)] + ["hot"] * 350 + [None] * 9 + ["é", "z" * 5000]
    df = spark.createDataFrame([(v, v) for v in values], "d string, given string").repartition(7)
    got = [(r.given, r.d) for r in curve.cells(df, ["d"], 4).collect()]
    known = sorted((v for v in values if v is not None), key=lambda v: v.encode())
    through = {v.encode(): n for n, v in enumerate(known, 1)}
    want = {v: min(15, through[v.encode()] * 16 // len(known)) for v in known}
    assert all(bucket == (0 if v is None else want[v]) for v, bucket in got)
    assert len({b for v, b in got if v and v.startswith("https")}) >= 10
    sharded = curve.curve_shards(df.withColumn("doc_id", F.monotonically_increasing_id()).withColumnRenamed("given", "text"),
                                 ["d"], 6, bits=4).collect()
    law(sharded, 6)
    assert curve.string_cuts(df.filter("d IS NULL"), "d", 3) == [] == curve.string_cuts(df.limit(0), "d", 3)
