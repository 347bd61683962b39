import math
import re
from collections import Counter

from joblode.llm import ratio
from tests.llm.conftest import SMALL, TEXTS, frame


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def failed(c):
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def test_base_counts(spark, odd):
    more = [(100, "a b c d e f a b c d e x a b c d e"), (101, "q q q q q q q"), (102, "\n\nx\nx\n \nx"), (103, "a b c d e"),
            (104, "\t#$ %&|<>* \x0b\x0c end\r\n")]
    for rows, df in ((TEXTS, odd), (more, frame(spark, more))):
        got = ratio.ratio_rules(df, df.limit(0)).collect()
        key = lambda i, c: str((i, *c, failed(c)))
        assert sorted(str((r.doc_id, *[r[f] for f in FIELDS], r.base_failed)) for r in got) == sorted(
            key(i, counts(t)) for i, t in rows)
        assert all(r.score == 0 and r.kept != r.base_failed for r in got)


def test_scores(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id")
    trusted = {r.doc_id for r in labels.collect()}
    rows = ratio.ratio_rules(small, labels, reject=0.05).collect()
    texts = {r.doc_id: r.text or "" for r in small.select("doc_id", "text").collect()}
    hashes = ratio.with_hashes(ratio.with_words(small, small["text"])).select("doc_id", "_h1", "_h2").collect()
    grams = {r.doc_id: [h % ratio.BUCKETS for h in r["_h1"] + r["_h2"]] for r in hashes}
    assert all(len(grams[i]) == max(0, 2 * len(t.split()) - 1) for i, t in texts.items())
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            target.update(g)
    n_raw, n_target = sum(raw.values()) + ratio.BUCKETS, sum(target.values()) + ratio.BUCKETS
    for r in rows:
        want = [math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in grams[r.doc_id]]
        assert abs(r.score - (sum(want) / len(want) if want else 0)) < 1e-9
        assert r.kept == (not r.base_failed and r.score >= r.threshold)
    low = sum(r.score < r.threshold for r in rows if r.doc_id in trusted)
    assert low <= 0.05 * len(trusted)


def test_many_trusted_ids_are_joined(small, spark, monkeypatch):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id")
    first = {(r.doc_id, r.kept, r.score) for r in ratio.ratio_rules(small, labels).collect()}
    monkeypatch.setattr(ratio, "BROADCAST_IDS", 0)
    assert {(r.doc_id, r.kept, r.score) for r in ratio.ratio_rules(small, labels).collect()} == first


def test_empty(empty, odd):
    assert ratio.ratio_rules(empty, odd.select("doc_id")).count() == 0
