from collections import Counter

import numpy as np

from cairn.llm.quality_rules import anomaly, grow_forest, q_op3, quality_rules
from tests.llm.helpers import WORD, docs, empty, odd_rows

LABELS = "doc_id long, quality int, toxic int"


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def check(rows, source):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(d), *base(t)) for d, t in source)
    assert all(not (r.kept and r.base_failed) for r in rows)


def test_odd_rows(spark):
    rep = " ".join(["one two three four five six seven eight nine"] * 5)
    rows = odd_rows() + [(20, rep, "en", "s", 1), (21, rep + " tail", "en", "s", 1), (22, "x\nx \nx\n y", "en", "s", 1)]
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (6, 0, 0), (6, 0, 0)], LABELS)
    out = quality_rules(docs(spark, rows), labels)
    check(out.collect(), [(r[0], r[1]) for r in rows])


def test_empty(spark):
    assert quality_rules(empty(spark), empty(spark, LABELS)).collect() == []
    assert quality_rules(docs(spark), empty(spark, LABELS)).count() == len(odd_rows())


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    s = anomaly(grow_forest(x[20:]), np.concatenate([x[:20] + 8, x[20:]]))
    assert s[:20].min() > np.quantile(s[20:], 0.98)


def test_query_and_labels(spark, sf_small):
    sf = sf_small.replace("0.001", "0.01")
    rows = q_op3(spark, sf).collect()
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r.kept for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if quality.get(r.doc_id) == 0 and not r.base_failed]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2
