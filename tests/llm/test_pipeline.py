from collections import Counter

import corpus_pipeline as pipeline
from joblode.llm import pii, quality
from joblode.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SMALL
from tests.llm.test_exact import digest
from tests.llm.test_neardup import bag, similarity
from tests.llm.test_packing import whole


def test_names():
    assert [n.split("_")[0] for n in QUERIES if n != "pipeline"] and set(ORACLE) <= set(QUERIES)
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}


def test_stages(spark, small):
    """Each stage against what its decisions must be on its own input, found by plain loops."""
    docs, rows = small, {r.doc_id: r for r in small.collect()}
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near-duplicates", "personal data", "packing"]

    good = pipeline.keep_good(spark, docs, SMALL)
    model = quality.train(docs, quality.quality_labels(spark, SMALL))
    want = {r.doc_id for r in quality.scored(docs, model).collect() if r.score >= 0.3}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    once = pipeline.drop_copies(spark, good, SMALL)
    first = {}
    for i in sorted(want):
        first.setdefault(digest(rows[i].text), i)
    assert Counter(r.doc_id for r in once.collect()) == Counter(first.values()) and once.columns == docs.columns

    apart = pipeline.drop_near_copies(spark, once, SMALL)
    kept = sorted(r.doc_id for r in apart.collect())
    assert len(set(kept)) == len(kept) and set(kept) <= set(first.values()) and apart.columns == docs.columns
    bags = {i: bag(rows[i].text) for i in first.values()}
    for n, a in enumerate(kept):
        assert all(similarity(bags[a], bags[b]) < 0.8 for b in kept[:n])

    masked = pipeline.mask_personal_data(spark, apart, SMALL)
    assert masked.columns == docs.columns
    out = masked.collect()
    assert sorted(r.doc_id for r in out) == kept
    assert not any(pii.base_spans(r.text) for r in out) and all(r.n_chars == len(r.text) for r in out)
    assert all(r.text == rows[r.doc_id].text for r in out if not pii.base_spans(rows[r.doc_id].text) and "<" not in r.text)

    packed = pipeline.pack(spark, masked, SMALL).collect()
    whole([(r.doc_id, r.text) for r in out], packed, 1024)

    assert sorted(map(str, pipeline.run(spark, SMALL).drop("sequence_id", "offset").collect())) == sorted(
        map(str, pipeline.pack(spark, masked, SMALL).drop("sequence_id", "offset").collect()))


def test_odd_documents(spark, odd, empty):
    for docs in (odd, empty):
        count = docs.count()
        for stage in (pipeline.keep_good, pipeline.drop_copies, pipeline.drop_near_copies, pipeline.mask_personal_data):
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns and out.count() <= count
        assert (pipeline.pack(spark, docs, SMALL).count() > 0) == (count > 0)
