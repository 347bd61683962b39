"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line or, with ``runs``, also the place where a line meets the next
ones of its paragraph: as many words before and after the line's end as the longest
template may take, so that a notice wrapped at any column lies within a block. A
run has the number of its first line. A template is found in a block if the block holds at least
``THRESHOLD`` of the template's distinct words (containment). The join is exact:

* words are ordered by how many blocks of the corpus hold them, rare ones first;
* a template that must share ``need`` of its ``size`` words with a block shares
  one of its first ``size - need + 1`` words with it (prefix filter), so only
  blocks with such a word go on;
* a block with fewer than ``need`` template words is out (length filter);
* at the first shared word, what is left of both must still reach ``need``
  (positional filter).

What passes is counted word by word. Short templates differ in a word or two, so
``find_licenses`` asks besides for the words that tell a template apart from its
neighbours (``TELLING``). Templates are a short list given by the
caller, so their words and prefixes go to every task as constants.

The base scan finds fixed phrases anywhere in a text, over line ends too.

Defined results: a null text counts as empty; a text without words has no
places, labels or score; a template without words finds nothing; repeated rows
are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm.registry import case, documents
from joblode.llm.tokens import narrow
from joblode.session import staged

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening sentences of public licenses, by label.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights"),
)
THRESHOLD = 0.8

# What the words of a block, joined by blanks, must hold to be the template at this place of ``TEMPLATES``.
TELLING = (
    r" apache ",
    r" except in compliance ",
    r" mit ",
    r" associated documentation ",
    r" gnu general public ",
    r" gnu general public ",
    r" lesser general public ",
    r" affero general public ",
    r" source and binary ",
    r" mozilla public ",
    r" by nc (?!(sa|nd) )",
    r" by sa ",
    r" attribution (?!(noncommercial|non|sharealike|share|noderivatives|noderivs|no) )",
    r" waived all copyright ",
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# A-Z lower-cased; bytes of other words and line ends stay, all others are blanks.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 or c == 10 else 32 for c in range(256))


def line_words(text: str | None) -> list[list[bytes]]:
    """The words of every line."""
    return [line.split() for line in (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split(b"\n")]


def need_of(size: int, threshold: float) -> int:
    """The smallest number of shared words that reaches the threshold."""
    return next(n for n in range(1, size + 1) if n >= threshold * size - 1e-9)


class Index:
    """Templates with their words in global order: rare words first, then by spelling."""

    def __init__(self, templates, threshold: float, frequency: dict[str, int]):
        sets = [(label, set(template_words(text))) for label, text in templates]
        self.sets = [(label, s) for label, s in sets if s]
        self.order = sorted({w for _, s in self.sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
        rank = {w: n for n, w in enumerate(self.order, 1)}
        self.rows = []
        prefixes: set[str] = set()
        for n, (label, s) in enumerate(self.sets):
            own, need = sorted(rank[w] for w in s), need_of(len(s), threshold)
            for at, r in enumerate(own[:len(own) - need + 1]):
                self.rows.append((r, n, label, at, len(own), need, own))
                prefixes.add(self.order[r - 1])
        self.prefixes = sorted(prefixes)


def template_words(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def block_frequency(docs: DataFrame, templates) -> dict[str, int]:
    """In how many blocks of all documents each template word stands."""
    known = {w.encode() for _, text in templates for w in template_words(text)}
    if not known:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                for line in line_words(text.as_py()):
                    held.update(known.intersection(line))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()),
                                          pa.array(list(held.values()), pa.int64())], names=["word", "count"])
    counts = docs.select("text").mapInArrow(run, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))
    return {r["word"]: r["count"] for r in counts.collect()}  # at most the templates' words


def base_places(lines: list[list[bytes]]) -> list[tuple[str, int]]:
    """(label, start) of each place where a phrase's words stand one after the other, over line ends too."""
    own = list(chain.from_iterable(lines))
    out = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        for at, word in enumerate(own):
            if word == parts[0] and own[at:at + len(parts)] == parts:
                out.append((label, at))
    return out


def run_words(lines: list[list[bytes]], at: int, length: int) -> list[bytes]:
    """Words of the run of line ``at``: ``length`` words before its end, and after it in its paragraph."""
    # A line without words ends the paragraph; every other one has a word, so ``length`` lines suffice.
    later = list(chain.from_iterable(takewhile(bool, lines[at + 1:at + 1 + length])))
    return lines[at][-length:] + later[:length]


class Blocks:
    """Finds the blocks of a text that hold a prefix word."""

    def __init__(self, index: Index, telling, length: int | None):
        self.ranks = {w.encode(): n for n, w in enumerate(index.order, 1)}
        self.known, self.prefixes = set(self.ranks), {w.encode() for w in index.prefixes}
        self.telling, self.length = [re.compile(t) for t in telling or ()], length

    def block(self, number: int, held: list[bytes]) -> dict:
        """The template words of a block, and which of the telling patterns its words satisfy."""
        text = " " + b" ".join(held).decode("utf-8", "surrogatepass") + " " if self.telling else ""
        return {"block": number, "ranks": sorted(self.ranks[w] for w in self.known.intersection(held)),
                "told": [n for n, t in enumerate(self.telling) if t.search(text)]}

    def of(self, lines: list[list[bytes]]) -> list[dict]:
        hot = [n for n, line in enumerate(lines) if not self.prefixes.isdisjoint(line)]
        out = [self.block(n, lines[n]) for n in hot]
        if self.length is None or not hot:
            return out
        # Runs that a hot line may lie in: those that begin up to ``length`` lines before it.
        starts = sorted({n for h in hot for n in range(max(0, h - self.length), h + 1)})
        return out + [self.block(n, run_words(lines, n, self.length)) for n in starts
                      if n + 1 < len(lines) and lines[n] and lines[n + 1]]


def read_blocks(docs: DataFrame, blocks: Blocks) -> DataFrame:
    """(doc_id, row, n_words, places, blocks) of each document."""
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    kind = pa.list_(pa.struct([("block", pa.int32()), ("ranks", pa.list_(pa.int64())), ("told", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places, found = [], [], []
            for text in batch.column("text"):
                lines = line_words(text.as_py())
                counts.append(sum(map(len, lines)))
                here = base_places(lines) if any(b"license" in line for line in lines) else []
                places.append([{"label": label, "start": start} for label, start in here])
                found.append(blocks.of(lines))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(places, place),
                 pa.array(found, kind)], names=["doc_id", "row", "n_words", "places", "blocks"])
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(
        run, "doc_id long, row long, n_words long, places array<struct<label:string,start:long>>, "
             "blocks array<struct<block:int,ranks:array<long>,told:array<int>>>")


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` of lines and runs for the public licenses; a match also holds the words that tell its template apart."""
    return scan(docs, id_col=id_col, text_col=text_col, telling=TELLING, runs=True)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text", telling=None, runs: bool = False) -> DataFrame:
    """(doc_id, n_words, places, base_labels, matches): one row per row of ``docs``.

    ``places``: (label, start) of every base phrase. ``matches``: (label, block, template, containment)
    of every block and template that reach the threshold; blocks are numbered from 0. ``telling``: a
    pattern for each template, which the words of a block must satisfy too. ``runs``: wrapped templates
    are found as well.
    """
    if telling is not None and len(telling) != len(templates):
        raise ValueError("a pattern for each template")
    if telling is not None:
        # Templates without words have no number.
        telling = [p for p, (_, t) in zip(telling, templates) if template_words(t)]
    spark, docs = docs.sparkSession, narrow(docs, id_col, text_col)
    index = Index(templates, threshold, block_frequency(docs, templates))
    length = None
    if runs and index.rows:
        longest = max(len(template_words(t)) for _, t in templates)
        # Words that come between, as marks of comments, take some room too.
        length = math.ceil(longest / min(threshold, 1))
    # Only blocks with a prefix word leave the scan, and of them only the template words.
    read = read_blocks(docs, Blocks(index, telling, length))
    read = staged(read, "license-scan")
    schema = ("rank long, template int, label string, at int, size int, need int, own array<long>")
    entries = F.broadcast(spark.createDataFrame(index.rows, schema))
    left = F.size("ranks") - F.col("pos") - 1
    pairs = (read.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.ranks", "b.told")
             .select("*", F.posexplode("ranks").alias("pos", "rank")).join(entries, "rank")
             .filter(F.size("ranks") >= F.col("need"))
             .filter(F.lit(True) if telling is None else F.array_contains("told", F.col("template")))
             .filter(1 + F.least(F.col("size") - F.col("at") - 1, left) >= F.col("need"))
             .withColumn("shared", F.size(F.array_intersect("ranks", "own"))).filter("shared >= need")
             .select("row", F.struct("label", "block", "template",
                                     (F.col("shared") / F.col("size")).alias("containment")).alias("match")))
    found = pairs.groupBy("row").agg(F.collect_set("match").alias("matches"))
    empty = F.array().cast("array<struct<label:string,block:int,template:int,containment:double>>")
    return read.join(found, "row", "left").select(
        "doc_id", "n_words", "places",
        F.array_join(F.array_sort(F.array_distinct(F.col("places.label"))), ",").alias("base_labels"),
        F.coalesce("matches", empty).alias("matches"))


@case("op8_license_scan")
def op8(spark, sf_dir):
    found = find_licenses(documents(spark, sf_dir))
    labels = F.concat(F.col("places.label"), F.col("matches.label"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        "base_labels", F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("score"))
