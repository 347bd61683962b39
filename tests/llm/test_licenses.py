import re

import pytest

from joblode.llm import licenses
from tests.llm.conftest import TEXTS, frame

ROWS = [(1, "Released under the MIT License.\nbody"), (2, "See the apache\nLICENSE and the Mit license; GNU General Public License."),
        (3, "This work is licensed under the GNU General Public License, version 3."), (4, None), (5, "license mit apache public"),
        (6, "Licensed under the Apache license"), (7, "x Licensed CC BY NC 4 y\nunder"), (8, "MİT License mit  license"),
        (9, "Permission is hereby granted free of charge to any person obtaining a copy of this software and docs"), (9, "mit license")]


def base(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        found += [(label, k) for k in range(len(words)) if words[k:k + len(parts)] == parts]
    return len(words), sorted(found)


def matches(text, templates, threshold):
    found = []
    for block, line in enumerate((text or "").split("\n")):
        own = set(re.findall(licenses.WORD, line.lower()))
        for n, (label, template) in enumerate(templates):
            words = set(re.findall(licenses.WORD, template.lower()))
            if words and len(words & own) >= threshold * len(words) - 1e-9:
                found.append((label, block, n, len(words & own) / len(words)))
    return sorted(found)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_against_all_pairs(spark, odd, small, threshold):
    for df in (frame(spark, ROWS), odd, small):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        want = sorted(str((i, *base(t), matches(t, licenses.TEMPLATES, threshold))) for i, t in texts)
        got = [(r.doc_id, r.n_words, sorted(map(tuple, r.places)), sorted(map(tuple, r.matches)))
               for r in licenses.scan(df, threshold=threshold).collect()]
        assert sorted(map(str, got)) == want


def test_random_templates(spark):
    import random

    rng = random.Random(2)
    rows = [(n, "\n".join(" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(9))) for _ in range(4))) for n in range(60)]
    templates = tuple((f"t{n % 3}", " ".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(1, 7)))) for n in range(9))
    got = licenses.scan(frame(spark, rows), templates, 0.6).collect()
    assert {r.doc_id: sorted(map(tuple, r.matches)) for r in got} == {i: matches(t, templates, 0.6) for i, t in rows}


def test_none(empty, odd):
    assert licenses.scan(empty).count() == 0
    assert all(not r.matches for r in licenses.scan(odd, templates=()).collect())
    assert len(TEXTS) == odd.count()


# By hand: what each line is, apart from its base phrases.
LINES = [
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}), ("Released under the MIT License.", {"mit"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache"}), ("Licensed under CC BY-SA 4.0.", {"cc-by-sa"}),
    ("Licensed under CC BY-NC-SA 4.0.", set()), ("Released under the GPL License", set()), ("Released under the BSD License", set()),
    ("Licensed under the GNU Lesser General Public License", {"lgpl"}),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", {"lgpl"}),
    ("This work is licensed under the GNU Affero General Public License, version 3.", {"agpl"}),
    ("This work is licensed under the GNU General Public License or the GNU Lesser General Public License, version 3", {"gpl", "lgpl"}),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", set()),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the Software)", {"mit"}),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license", set()),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met:", {"bsd"}),
    ("To the extent possible under law, the author has waived all copyright and related rights", {"cc0"})]


def test_labels_by_hand(spark):
    got = licenses.find_licenses(frame(spark, [(n, t) for n, (t, _) in enumerate(LINES)])).collect()
    assert {r.doc_id: {m.label for m in r.matches} for r in got} == {n: labels for n, (_, labels) in enumerate(LINES)}


def test_each_template_is_told_apart(spark):
    rows = [(n, text) for n, (_, text) in enumerate(licenses.TEMPLATES)]
    got = licenses.find_licenses(frame(spark, rows)).collect()
    assert all(n in {m.template for m in r.matches} for r in got for n in [r.doc_id])
    assert {r.doc_id: {m.label for m in r.matches} for r in got} == {n: {label} for n, (label, _) in enumerate(licenses.TEMPLATES)}


HEADERS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
           "files (the \"Software\"), to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
           "conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
           "as published by the Free Software Foundation",
    "cc-by-nc": "Some words. Licensed under CC BY-NC 4.0. More words"}


@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_headers(spark, mark):
    import textwrap

    rows = [(n, name, "\n".join(mark + line for line in ["Title", "", *textwrap.wrap(text, width, break_long_words=False), "", "Other paragraph"]))
            for n, (name, text, width) in enumerate((name, text, w) for name, text in HEADERS.items() for w in (12, 30, 72, 80))]
    got = {r.doc_id: {m.label for m in r.matches} for r in licenses.find_licenses(frame(spark, [(n, t) for n, _, t in rows])).collect()}
    assert got == {n: {name} for n, name, _ in rows}


def test_runs_stay_in_a_paragraph(spark):
    rows = [(1, "Licensed under CC\n\nBY-NC 4.0"), (2, "Licensed under CC\nBY-NC 4.0"), (3, ""), (4, None), (5, "Licensed under CC BY-NC 4.0\n"),
            (6, "word " * 500 + "Licensed under CC\nBY-NC 4.0 " + "word " * 500), (7, "Licensed under CC\n" + "word " * 60 + "\nBY-NC 4.0")]
    got = {r.doc_id: sorted({m.label for m in r.matches}) for r in licenses.find_licenses(frame(spark, rows)).collect()}
    assert got == {1: [], 2: ["cc-by-nc"], 3: [], 4: [], 5: ["cc-by-nc"], 6: ["cc-by-nc"], 7: []}
