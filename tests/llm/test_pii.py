import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from joblode.llm import pii
from tests.llm.conftest import frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1234567890.@+-() _%é\n", max_size=80))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


SAMPLES = ["a@b.c@d.e x.y@z.com.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
           "+1 (338) 555-7198, +12 3", "no data", "", "1" * 3000, "a" * 3000 + "@", "@" * 500]


def test_samples():
    for text in SAMPLES:
        assert pii.base_spans(text) == plain(text)
    assert len(pii.base_spans("4111 1111 1111 1111")) == 1


def test_estimates():
    rng = random.Random(3)
    counts = {}
    truth = {}
    for _ in range(4000):  # labelers that are right nine times of ten, with one that is a coin
        right = rng.random() < 0.6
        votes = [(2 if (rng.random() < 0.9) == right else 1) for _ in range(3)] + [rng.choice([1, 2])]
        code = 0
        for v in votes:
            code = 3 * code + v
        counts[16 * code] = counts.get(16 * code, 0) + 1
        truth.setdefault(16 * code, []).append(right)
    prior, table, right = pii.reliabilities(counts)
    assert abs(prior - 0.6) < 0.1
    assert all(table[1, k, 2] > 0.8 and table[0, k, 1] > 0.8 for k in range(3)) and abs(table[1, 3, 2] - 0.5) < 0.15
    result = pii.span_classifier(counts, right)
    share = sum(n * np.mean([t == (result[p] >= 0.5) for t in truth[p]]) for p, n in counts.items()) / sum(counts.values())
    assert share > 0.9


def test_documents(spark, odd, empty):
    rows = [(1, "Mail ann@x.org or call +1 (338) 555-7198; password=9855ae4fa49702326c ok"), (2, None), (3, ""),
            (4, "bob [at] site [dot] com"), (4, "bob [at] site [dot] com"), (5, "10.0.0.1 4111111111111111")]
    rows += [(10 + i, f"text {i} token: ab12cd34ef56gh{i:02d}") for i in range(20)]
    got = {(r.doc_id, r.base_sha256): r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    for i, text in rows:
        base = plain(text or "")
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        row = got[i, hashlib.sha256(listed.encode()).hexdigest()]
        spans = [(s.start, s.kind, s.end) for s in row.spans]
        assert set(base) <= set(spans) and spans == sorted(spans)
    secret = [r for (i, _), r in got.items() if i == 1][0].spans[-1]
    assert rows[0][1][secret.start:secret.end] == "password=9855ae4fa49702326c"
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(empty).count() == 0
    masked = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert masked[1] == "Mail <EMAIL> or call <PHONE>; <SECRET> ok" and masked[2] is None and masked[5] == "<IP> <CARD>"
    assert pii.redact(odd).columns == odd.columns and pii.redact(empty).count() == 0


def test_python_and_column_paths_agree(small):
    found = pii.scan(small).cache()
    taken = {k: set(p) for k, p in pii.accepted(found).items()}
    texts = {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}
    for r in pii.find_personal_data(small).collect():
        assert [(s.start, s.kind, s.end) for s in r.spans] == pii.all_spans(texts[r.doc_id], taken)


KEY = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
JWT = ".".join("eyJ" + "aB3_-x9Z" * n for n in (5, 60, 9))
SECRETS = [f'token = "{KEY}"', f"token='{KEY}'", f'"token": "{KEY}"', f"'api_key' : '{KEY}'", f"token={KEY}", f"secret: {JWT}",
           f'"auth":"{JWT}"', f'password = "{KEY[:12]}!$%&"', f'\\"token\\": \\"{KEY}\\"', f'token = "{"f0" * 4000}"',
           f'token = "a{"4111111111111111"}b{KEY}"', f"token =\t{KEY}=="]


def test_quoted_and_long_secrets(spark):
    import corpus_pipeline

    rows = [(n, f"word {s} next") for n, s in enumerate(SECRETS)]
    for r in pii.find_personal_data(frame(spark, rows)).collect():
        text, secrets = rows[r.doc_id][1], [s for s in r.spans if s.kind == 4]
        assert [text[s.start:s.end].strip("\\\"'") for s in secrets] == [SECRETS[r.doc_id].strip("\\\"'")], text
    for r in corpus_pipeline.mask_personal_data(spark, frame(spark, rows), "").collect():
        assert r.text.replace("\\", "").replace('"', "") == "word <SECRET> next"
        assert r.n_chars == len(r.text)


def test_secrets_of_the_samples(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in docs.select("text").collect() if r.text]
    planted = [(t, m.span()) for t in texts for m in re.finditer(r'(?i)token = "[0-9a-f]{40}"', t)]
    assert planted
    taken = {k: set(p) for k, p in pii.accepted(pii.scan(docs)).items()}
    for text, (start, end) in planted:
        assert (start, 4, end) in pii.all_spans(text, taken)
        assert text[start:end] not in pii.redacted(text, taken)


def test_secret_pattern_is_linear():
    import time

    for part in ('aa="', "aa=", "aa='\"", 'aa="\\', "a", "aa ", 'aa="b', "'aa'", "aa=\\'"):
        started = time.perf_counter()
        pii.proposals(part * 100_000, [])
        assert time.perf_counter() - started < 5, part


def test_long_addresses_leave_no_tail():
    for text in ("x" * 300 + " [at] host.example.org", "bob [at] a.bb.cc.dd.ee.ff.gg", "bob (at) " + "h" * 90 + " dot org"):
        (start, kind, end, _), = pii.proposals(f"mail {text} now", [])
        assert kind == 0 and f"mail {text} now"[start:end] == text


def test_classifier_at_any_size():
    counts = {16 * 50 + 2: 30, 16 * 10 + 1: 50, 16 * 77: 20}
    targets = {p: q for p, q in zip(counts, (0.9, 0.2, 0.6))}
    small = pii.span_classifier(counts, targets)
    large = pii.span_classifier({p: 1_000_000 * n for p, n in counts.items()}, targets)
    assert all(abs(small[p] - large[p]) < 1e-6 for p in counts)
