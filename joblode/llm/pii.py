"""Personal data by weak supervision.

Base spans (e-mail, address of a host, payment card, phone) are found by fixed
patterns and always stay. Wider patterns propose further spans. Three kinds of
labelers vote on each proposal, for, against or not at all:

* regex: does it have a strict form (checksum, lengths, separators);
* gazetteer: does it hold a known value (domain ending, calling code, issuer
  digits, reserved network);
* context: do the words before it name the kind of data, or something else.

Expectation-maximisation estimates from all proposals of the corpus how reliable
each labeler is and how often a proposal of each kind is right, without labels.
Its probabilities train the final classifier, a logistic regression over the
votes and the span's shape; a proposal becomes a span if the classifier says so.
Votes and shapes are small integers, so both steps work on counts of their
combinations: the driver holds a table whose size the number of labelers and
shapes bounds, whatever the corpus holds.

Only proposals leave the scan, never texts. Defined results: a null text counts
as empty and has no spans; a proposal that overlaps a base span (unless that is
only a part of a secret's value) or an earlier accepted proposal is dropped; a kind without proposals adds none; repeated rows
are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm.bpe import texts_of
from joblode.llm.registry import case, documents
from joblode.llm.tokens import narrow
from joblode.session import staged

# Kinds of the base spans, in the order in which spans that start together are listed; then the method's own.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

# A match is the tail of an address; what stands left of the @ is read from there.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Starting only at the first digit of a run and never giving digits back finds the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if n % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, in order; kinds by their place in ``KINDS``."""
    found = []
    after = 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > after and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                after = m.end()
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                parts = [p.lstrip("0") for p in m[0].split(".")]
                if all(len(p) < 4 and int(p or 0) < 256 for p in parts):
                    found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# Proposals beyond the base patterns, by kind. Each starts at a bounded look-behind or at a rare letter.
_PROPOSALS = {
    # Runs are unbounded and never give letters back, here and in the last pattern.
    0: re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]++"
                  r"(?: ?(?:\.|\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{2,}+)++"),
    2: re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]?[0-9]{4}){2}[ ./-]?[0-9]{3,4}(?![0-9])"),
    3: re.compile(r"(?<![0-9+.])(?:00 ?[0-9]{1,3}[ ./-]?)?\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9.])"),
    # Name and value may stand in quotes, also escaped ones.
    4: re.compile(r"""(?:(["'])[A-Za-z_]{2,}+\1|(?<![A-Za-z0-9_])[A-Za-z_]{2,}+(?:\\?["'])?)[ \t]*+[=:][ \t]*+"""
                  r"""(?P<value>"(?:[^\s"\\]|\\\S){8,}+"|'(?:[^\s'\\]|\\\S){8,}+'|"""
                  r"""(?P<open>\\?["'])?[A-Za-z0-9+/_.-]{8,}+=*+(?(open)(?:\\?["'])?))"""),
}
# What a text must hold to have a proposal of the kind at all.
_HINTS = {0: re.compile(r"[\[({ ]at[\])} ]"), 2: re.compile(r"[0-9]{4}"), 3: re.compile(r"[0-9]{2}"),
          4: re.compile(r"[=:][ \t]*+\S{8}")}

# Gazetteers and words of context.
ENDINGS = frozenset("com org net edu gov io de fr es uk eu info example".split())
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "65")
SECRET_NAMES = frozenset("password passwd pwd secret token apikey api_key access_key auth private_key".split())
NAMED = {0: frozenset("mail email e-mail contact write address correo courriel".split()),
         2: frozenset("card visa mastercard credit debit tarjeta carte karte".split()),
         3: frozenset("phone tel call mobile fax telefon cell sms llame appelez".split()),
         4: frozenset("login key credentials secret config export set".split())}
OTHER = frozenset("version isbn issn order invoice page pages year chapter section rfc figure table id no".split())
LABELERS = ("strict form", "known value", "named before", "other before")
_BEFORE = re.compile(r"[^\W\d_][\w-]*")


def votes(kind: int, span: str, before: str) -> tuple[int, ...]:
    """One vote per labeler: 2 for, 1 against, 0 none."""
    words = {w.lower() for w in _BEFORE.findall(before)}
    digits = digits_of(span)
    if kind == 0:
        strict = 2 if "[" in span or "(" in span or "{" in span else 1 if "." not in span and "dot" not in span else 0
        known = 2 if re.split(r"[^A-Za-z]+", span)[-1].lower() in ENDINGS else 1
    elif kind == 2:
        strict = 2 if 14 <= len(digits) <= 19 and luhn(digits) else 1
        known = 2 if digits.startswith(CARD_STARTS) else 1
    elif kind == 3:
        strict = 2 if 9 <= len(digits) <= 15 and re.search(r"[()]|[0-9]-[0-9]", span) else 1 if len(digits) < 9 else 0
        known = 2 if digits.startswith("00") or digits.startswith("0") else 0
    else:
        name, value = (part.strip("\"'\\ \t") for part in re.split("[=:]", span, maxsplit=1))
        mixed = bool(re.search("[0-9]", value)) and bool(re.search("[A-Za-z]", value))
        strict = 2 if mixed and len(value) >= 12 else 1 if not mixed else 0
        known = 2 if name.lower() in SECRET_NAMES else 1
    return (strict, known, 2 if words & NAMED[kind] else 0, 1 if words & OTHER else 0)


def shape(span: str) -> int:
    """Length and share of digits, each in four steps."""
    share = sum(map(span.count, "0123456789")) / len(span)
    return 4 * min(3, len(span) // 12) + min(3, int(4 * share))


def _alone(before: str, after: str) -> bool:
    """Whether nothing but quotes and blanks stands around."""
    return not (before + after).strip("\"'\\ .")


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, pattern) of proposals clear of base spans; pattern: votes and shape in one number."""
    found = []
    for kind, pattern in _PROPOSALS.items():
        if not _HINTS[kind].search(text):
            continue
        for m in pattern.finditer(text):
            # Digits inside a longer secret may look like a card or a host; they are a part of it.
            low, high = m.span("value") if kind == 4 else (m.end(), m.end())
            if any(s < m.end() and m.start() < e and not (low <= s and e <= high and not _alone(text[low:s], text[e:high]))
                   for s, _, e in base):
                continue
            code = 0
            for v in votes(kind, m[0], text[max(0, m.start() - 40):m.start()]):
                code = 3 * code + v
            found.append((m.start(), kind, m.end(), 16 * code + shape(m[0])))
    return sorted(found)


def unpack(pattern: int) -> tuple[list[int], int]:
    """(votes, shape) of a pattern."""
    code, form = divmod(pattern, 16)
    return [code // 3 ** k % 3 for k in reversed(range(len(LABELERS)))], form


SCANNED = ("doc_id long, base array<struct<start:long,kind:int,end:long>>, base_sha256 string, "
           "more array<struct<start:long,kind:int,end:long,pattern:int>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, base_sha256, more): the base spans and the proposals of every whole text."""
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    more_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()),
                                    ("pattern", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            bases, hexes, more = [], [], []
            for text in texts:
                base = base_spans(text or "")
                bases.append([dict(zip(("start", "kind", "end"), s)) for s in base])
                hexes.append(hashlib.sha256(",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in base]).encode()).hexdigest())
                more.append([dict(zip(("start", "kind", "end", "pattern"), p)) for p in proposals(text or "", base)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(bases, base_type), pa.array(hexes, pa.string()),
                 pa.array(more, more_type)], names=["doc_id", "base", "base_sha256", "more"])
    return narrow(docs, id_col, text_col).mapInArrow(run, SCANNED)


def reliabilities(counts: dict[int, int], steps: int = 50) -> tuple[float, np.ndarray, dict[int, float]]:
    """Expectation-maximisation over one kind's vote patterns and their counts.

    Returns the share of right proposals, p[right?][labeler][vote], and each pattern's probability of
    being right. It starts from labelers that are right more often than not.
    """
    rows = [(unpack(p)[0], n, p) for p, n in sorted(counts.items())]
    cast, weight = np.array([v for v, _, _ in rows]), np.array([n for _, n, _ in rows], float)
    prior = 0.5
    table = np.empty((2, len(LABELERS), 3))
    table[1], table[0] = (0.4, 0.1, 0.5), (0.4, 0.5, 0.1)
    for _ in range(steps):
        logs = [np.log(q) + np.log(table[c][np.arange(len(LABELERS)), cast]).sum(axis=1)
                for c, q in ((0, 1 - prior), (1, prior))]
        right = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        prior = float(np.clip((right @ weight + 1) / (weight.sum() + 2), 0.001, 0.999))
        for c, w in ((0, (1 - right) * weight), (1, right * weight)):
            start = (0.4, 0.1, 0.5) if c else (0.4, 0.5, 0.1)
            for k in range(len(LABELERS)):
                seen = np.bincount(cast[:, k], w, 3) + 4 * np.array(start)
                table[c, k] = seen / seen.sum()
    return prior, table, {p: float(q) for (_, _, p), q in zip(rows, right)}


def features(pattern: int) -> np.ndarray:
    cast, form = unpack(pattern)
    out = np.zeros(1 + 2 * len(LABELERS) + 8)
    out[0] = 1
    for k, v in enumerate(cast):
        if v:
            out[1 + 2 * k + v - 1] = 1
    out[1 + 2 * len(LABELERS) + form // 4] = 1
    out[5 + 2 * len(LABELERS) + form % 4] = 1
    return out


def span_classifier(counts: dict[int, int], targets: dict[int, float], ridge: float = 1e-4,
                    steps: int = 30) -> dict[int, float]:
    """Logistic regression of the estimated probabilities on votes and shapes: each pattern's result.

    Patterns weigh by their share of all proposals, so the ridge is as strong at any size of the corpus.
    """
    x = np.array([features(p) for p in counts])
    w, y = np.array(list(counts.values()), float), np.array([targets[p] for p in counts])
    w = w / w.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - q)) - ridge * beta
        bend = (x * (w * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta = beta + np.linalg.solve(bend, slope)
    return {p: float(v) for p, v in zip(counts, 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))))}


def accepted(scanned: DataFrame, least: float = 0.5) -> dict[int, list[int]]:
    """Patterns, by kind, that the trained classifier takes for personal data."""
    counted = scanned.select(F.explode("more").alias("m")).groupBy("m.kind", "m.pattern").count().collect()
    out: dict[int, list[int]] = {}
    for kind in sorted({r["kind"] for r in counted}):
        counts = {r["pattern"]: r["count"] for r in counted if r["kind"] == kind}
        counts = dict(sorted(counts.items()))
        result = span_classifier(counts, reliabilities(counts)[2])
        out[kind] = [p for p, q in result.items() if q >= least]
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, base_sha256, spans): one row per row of ``docs``; spans are ordered by start and kind.

    Spans are structs of start, kind (place in ``KINDS``) and end; ``spans`` holds the base spans too.
    """
    scanned = staged(scan(docs, id_col, text_col), "pii-scan")
    codes = [k * 2**20 + p for k, ps in accepted(scanned).items() for p in ps]
    known = F.array(*[F.lit(c) for c in sorted(codes)]).cast("array<int>")
    taken = F.filter("more", lambda m: F.array_contains(known, m["kind"] * 2**20 + m["pattern"]))
    # Of proposals that overlap, the one that starts first stays.
    clear = F.aggregate(taken, F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"), lambda acc, m: F.when(
        (F.size(acc) == 0) | (F.get(acc, F.size(acc) - 1)["end"] <= m["start"]),
        F.concat(acc, F.array(F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))))
        .otherwise(acc))
    return scanned.select("doc_id", "base", "base_sha256", F.array_sort(F.concat("base", clear)).alias("spans"))


def all_spans(text: str, taken: dict[int, set[int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans of one text, given the accepted patterns."""
    base = base_spans(text)
    more, after = [], 0
    for start, kind, end, pattern in proposals(text, base):
        if pattern in taken.get(kind, ()) and start >= after:
            more.append((start, kind, end))
            after = end
    return sorted(base + more)


def redacted(text: str | None, taken: dict[int, set[int]]) -> str | None:
    """The text with each span replaced by its kind; of spans that overlap, by the first one's."""
    if not text or not (spans := all_spans(text, taken)):
        return text
    parts, after = [], 0
    for start, kind, end in spans:
        if start >= after:
            parts += [text[after:start], f"<{KINDS[kind].upper()}>"]
        after = max(after, end)
    return "".join([*parts, text[after:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text; null texts stay null."""
    taken = {k: set(p) for k, p in accepted(staged(scan(docs, id_col, text_col), "pii-scan")).items()}

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, taken) for t in texts], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def span_list(spans: str):
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@case("op2_personal_data")
def op2(spark, sf_dir):
    found = find_personal_data(documents(spark, sf_dir))
    of_kind = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n))
    counts = [of_kind(n).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return found.select("doc_id", *counts, "base_sha256", span_list("spans").alias("spans"))
