"""License scans against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.llm import licenses
from contrail.llm.queries import QUERIES
from contrail.llm.text import words


def slow_base(text):
    parts = words((text or "").encode())
    places, labels = [], set()
    for label, phrase in licenses.PHRASES:
        own = phrase.encode().split()
        for at in range(len(parts)):
            if parts[at : at + len(own)] == own:
                places.append(at)
                labels.add(label)
    return len(parts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def slow_labels(own, templates, containment):
    """Labels of the templates that a short enough run of the words meets."""
    found = set()
    for label, notice in templates:
        tokens = set(notice.split())
        longest = max(1, int(len(notice.split()) / containment + 1e-9))
        for at in range(len(own)):
            if len(tokens.intersection(own[at : at + longest])) >= containment * len(tokens) - 1e-9:
                found.add(label)
    return found


@pytest.mark.parametrize("containment", [0.3, 0.6, 0.9, 1.0])
def test_join_is_exact(containment, monkeypatch):
    monkeypatch.setattr(licenses, "LEAST_BLOCK", 2)
    draw = random.Random(8)
    letters = [c * 2 for c in "abcdefghijk"]
    for _ in range(150):
        templates = tuple(
            (f"t{k}", " ".join(draw.choice(letters) for _ in range(draw.randint(1, 7)))) for k in range(draw.randint(1, 4))
        )
        tokens = frozenset(t.encode() for _, notice in templates for t in notice.split())
        counts = {t: draw.randint(0, 5) for t in tokens}
        join = licenses.Join(templates, licenses.PHRASES, counts, containment)
        own = [draw.choice([*letters, "zz"]) for _ in range(draw.randint(0, 60))]
        ranks = np.array([join.rank.get(w.encode(), -1) for w in own], np.int64)
        found = join._stretch(ranks, join.is_prefix[ranks], 0, len(own))
        assert {label for _, _, label, _ in found} == slow_labels(own, templates, containment)
        for start, end, label, share in found:
            tokens = [set(notice.split()) for name, notice in templates if name == label][0]
            assert share == len(tokens.intersection(own[start:end])) / len(tokens) >= containment - 1e-9


def test_outermost_against_brute_force():
    draw = random.Random(9)
    for _ in range(400):
        every = []
        for _ in range(draw.randint(0, 7)):
            start = draw.randint(0, 6)
            every.append((start, start + draw.randint(1, 6), draw.choice("abc"), 1.0))
        covers = lambda o, s: o[0] <= s[0] and o[1] >= s[1] and o[:2] != s[:2] and o[2] != s[2]
        wanted = [s for s in every if not any(covers(o, s) for o in every)]
        assert licenses.outermost(every, every) == wanted


def scanned(text, templates=licenses.TEMPLATES):
    tokens = {t: 1 for _, n in templates for t in words(n.encode())}
    return licenses.Join(templates, licenses.PHRASES, tokens, 0.95).scan(text.encode())


def test_no_label_from_words_that_stand_apart():
    assert scanned("Licensed under the GNU Lesser General Public License, version 3")["labels"] == ["lgpl-3"]
    assert scanned("Licensed under the GNU Affero General Public License, version 3")["labels"] == ["agpl-3"]
    assert scanned("Licensed under the GNU General Public License version 3, see section 2")["labels"] == ["gpl-3"]
    apart = "The MIT team released a paper last year. Their driving license law falls under state control"
    assert scanned(apart)["labels"] == [] and scanned(apart)["score"] == 0.0


def test_long_templates():
    mit = max((notice for label, notice in licenses.TEMPLATES if label == "mit"), key=len).split()
    for width in (1, 7, 12, 400):
        lines = ["# " + " ".join(mit[k : k + width]) for k in range(0, len(mit), width)]
        text = "before it " * 211 + "\n" + "\n".join(lines) + "\nafter " * 150
        found = scanned(text)
        stretches = found["blocks"] + found["wrapped"]
        assert found["labels"] == ["mit"] and any(s >= 422 and s + 75 < e <= 422 + len(mit) for s, e, *_ in stretches)
    long = (("own", " ".join(f"w{k}" for k in range(1500))),)
    for shift in (0, 333, 2999):
        text = "x " * shift + long[0][1] + " y" * 500
        assert scanned(text, long)["labels"] == ["own"]
        assert scanned(text.replace("w700 ", "w700 " + "z " * 160), long)["labels"] == []


def test_documents(spark):
    texts = ["Released under the MIT License.", "Under the\nMIT license, under the mit LICENSE", None, "", "cc by nc cc BY-NC",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
             "the under license " * 30_000, "x " * 200 + "Licensed under the Apache License, Version 2.0. " + "y " * 300]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string").withColumn("labels", F.lit(1))
    found = {r.doc_id: r for r in licenses.scan_documents(docs).collect()}
    assert len(found) == len(texts) + 1
    for key, row in found.items():
        text = [*texts, texts[0]][key]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, ",".join(row.base_labels)) == slow_base(text)
        assert set(row.base_labels) <= set(row["labels"]) and 0 <= row.score <= 1
    assert [found[k]["labels"] for k in (0, 5, 6, 7, 8)] == [["mit"], ["gpl-3"], ["apache-2"], [], ["apache-2"]]
    assert licenses.scan_documents(docs.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in QUERIES["op3_licenses"](spark, folder).collect():
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == slow_base(texts[row.doc_id])


def test_wrapped_notices(spark):
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
        "bsd": " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following conditions\r\n * are met:",
        "gpl-3": "# Licensed under the GNU General Public\n#\n# License, version 3",
    }
    words_before = "x y " * 150 + "\n" + "z\n" * 77
    rows = [(label, front + notice + behind) for label, notice in notices.items() for front in ("", words_before) for behind in ("", "\nend " * 200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = licenses.scan_documents(docs).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row["labels"] == [row.doc_id] and row.score == 1.0
        assert row.blocks == [] and row.wrapped
    apart = "Licensed under the Apache\n" + "word " * 70 + "\nLicense, Version 2.0"
    join = licenses.Join(licenses.TEMPLATES, licenses.PHRASES, {t: 1 for _, n in licenses.TEMPLATES for t in words(n.encode())}, 0.95)
    assert join.scan(apart.encode())["labels"] == []
