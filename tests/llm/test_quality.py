import zlib

from joblode.llm import quality
from tests.llm.conftest import SMALL, frame

LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = quality.quality_labels(spark, LARGER)
    model = quality.train(docs, labels)
    assert model.rules and len(model.rules) < 100
    assert all(s in quality.STATISTICS for rule in model.rules for s, _, _ in rule)
    rows = quality.scored(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50
    good = [r.score for r in held if r.label == 1]
    bad = [r.score for r in held if r.label == 0]
    assert sum(g > b for g in good for b in bad) > 0.9 * len(good) * len(bad)
    assert sum((r.score >= 0.3) == (r.label == 1) for r in held) > 0.9 * len(held)


def test_rules_are_compiled_as_learned(small, spark):
    model = quality.train(small, quality.quality_labels(spark, SMALL))
    for r in quality.with_statistics(small).withColumn("score", model.score()).collect():
        total = model.intercept + sum(w for rule, w in model.rules.items() if all(
            r[s] <= b if most else r[s] > b for s, most, b in rule))
        assert abs(r.score - 1 / (1 + 2.718281828459045 ** -total)) < 1e-9


def test_held_out_fold():
    assert quality.FOLDS == 5 and quality.HELD_OUT == 0


def test_odd(spark, odd, empty):
    labels = frame(spark, [(1, 1.0), (7, 0.0), (None, 1.0), (8, None)], "doc_id long, label double")
    for given in (labels, labels.limit(0), labels.filter("label = 1")):
        model = quality.train(odd, given)
        rows = quality.scored(odd, model, score="quality").collect()
        assert len(rows) == odd.count() and all(0 <= r.quality <= 1 for r in rows)
    assert quality.train(odd, labels.limit(0)).constant == 0.5
    assert quality.keep_good(odd, model).columns == odd.columns
    assert quality.scored(empty, model, score="quality").count() == 0
    assert quality.train(empty, labels).constant == 0.5
    ids = frame(spark, [(i,) for i in range(50)], "doc_id long").select("doc_id", quality.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ids)


def test_kept_rows_are_read_once(odd):
    """However many rules there are, a text is cut into words once, and the filter keeps what the score says."""
    rules = {tuple(sorted([("s_words", False, b / 10), ("s_distinct", True, 0.9)])): 0.1 * b for b in range(12)}
    rules |= {(("s_line_words", False, float(b)),): -0.1 for b in range(9)}
    model = quality.Model(-0.5, rules)
    kept = quality.keep_good(odd, model, 0.4)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("split(") == 2
    want = [tuple(r)[:-1] for r in quality.scored(odd, model, score="_s").filter("_s >= 0.4").collect()]
    assert 0 < len(want) < odd.count()
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str) and kept.columns == odd.columns
