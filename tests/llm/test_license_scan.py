import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import license_scan as L
from cairn.llm.license_scan import BASE, RULES, q_op6, resolve, scan_licenses
from tests.llm.helpers import docs, empty, lower_az, odd_rows, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall(lower_az(text or ""))
    places, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(rows, source):
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=key) == \
        sorted(((d, *base(t)) for d, t in source), key=key)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)


CASES = [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("(CC BY-NC-SA 4.0)", "cc-by-nc-sa-4.0"),
    ("This is CC BY work", "cc-by"), ("GNU General Public License v3", "gpl-3.0"), ("GNU GENERAL PUBLIC LICENSE", "gpl"),
    ("All rights reserved.", "reserved"), ("dedicated to the public domain", "public-domain"),
    ("Creative Commons Attribution-ShareAlike 3.0", "cc-by-sa-3.0"), ("GNU Lesser General Public License version 2.1", "lgpl-2.1"),
]


def test_rules(spark):
    assert len(RULES) >= 250
    source = [(i, f"{sentence(i, 40)}\n{t} {sentence(i + 500, 40)}") for i, (t, _) in enumerate(CASES)]
    rows = {r.doc_id: r for r in scan_licenses(docs(spark, [(d, t, "", "", 0) for d, t in source])).collect()}
    check(list(rows.values()), source)
    for i, (_, label) in enumerate(CASES):
        assert label in rows[i].labels.split(","), (CASES[i], rows[i].labels)
    # containment: the name inside a grant, the shorter variant inside the longer one
    assert rows[0].labels == "apache-2.0" and len(rows[0].detections) == 1
    assert set(rows[3].labels.split(",")) == {"cc-by", "cc-by-nc-sa-4.0"}  # the base label stays


def test_resolution():
    order = sorted(range(len(RULES)), key=lambda r: -RULES[r].priority)
    hi, lo = order[0], order[-1]
    assert resolve([(5, 9, hi), (6, 8, lo), (6, 10, lo), (100, 103, lo), (100, 103, lo)]) == [(5, 9, hi), (6, 10, lo), (100, 103, lo)]


def test_odd_rows_and_empty(spark):
    hot = "cc by all rights reserved general public license CC-BY\n" * 400
    rows = odd_rows() + [(20, hot, "", "", 0), (21, "cc", "", "", 0), (22, "by cc", "", "", 0), (23, "ccéby cc by", "", "", 0)]
    check(scan_licenses(docs(spark, rows)).collect(), [(r[0], r[1]) for r in rows])
    assert scan_licenses(empty(spark)).collect() == []


def test_query_whole_table(spark, sf_small):
    sf = sf_small.replace("0.001", "0.01")
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = q_op6(spark, sf).collect()
    check(rows, source)
    apache = {d for d, t in source if "Licensed under the Apache License" in t}
    assert apache and all("apache-2.0" in r.labels for r in rows if r.doc_id in apache)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_prefilter_loses_nothing_that_the_rules_alone_find(data):
    rules = data.draw(st.lists(st.sampled_from(L.RULES), min_size=1, max_size=3))
    words = []
    for r in rules:
        found = data.draw(st.from_regex(r.pattern, fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyz 0123456789"))
        words += ["kamo", *found.split(), "rilu"]
    text = " ".join(words)
    every = []
    place = np.cumsum([0] + [len(x) + 1 for x in words])
    for i, c in enumerate(L._COMPILED):
        every += [(int(np.searchsorted(place, m.start())), int(np.searchsorted(place, m.end())), i) for m in c.finditer(text)]
    want = [(a, b, L.RULES[i].label) for a, b, i in L.resolve(every)]
    raw = np.frombuffer(text.encode(), np.uint8)
    got = L.scan(raw, np.array([0, len(raw)]))[0][7]
    assert [(d["from_word"], d["to_word"], d["label"]) for d in got] == want


def test_version_glued_to_a_name():
    for text, label in (("Licensed under AGPL3", "agpl-3.0"), ("Distributed under gpl3 terms", "gpl-3.0"), ("GPL2 or newer", "gpl-2.0"),
                        ("registered trademarks of Acme", "trademark")):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert label in L.scan(raw, np.array([0, len(raw)]))[0][5].split(","), text


def test_keywords_stand_in_every_form_of_their_pattern():
    for text, label in (("under the GNU Library General Public License version 2.1 only", "lgpl-2.1"),
                        ("under the GNU Lesser General Public License version 2.1 only", "lgpl-2.1"),
                        ("Permission to use, copy, modify, and/or distribute this software for any purpose", "isc"),
                        ("may not be used for AITraining", "no-training"), ("may not be used for AI training", "no-training")):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert [d["label"] for d in L.scan(raw, np.array([0, len(raw)]))[0][7]] == [label], text
