import math
import random
from collections import Counter

import numpy as np

from cairn.llm import decontamination as D
from tests.llm.helpers import WORD, docs, empty, lower_az, odd_rows, sentence

ITEMS = "item_id long, text string"


def words(t):
    return WORD.findall(lower_az(t or ""))


def brute(source, items, threshold, passage):
    """Every passage against every item, scored term by term."""
    items = [(i, t) for i, t in items if i is not None and words(t)]
    df = Counter(w for _, t in items for w in set(words(t)))
    mean = sum(len(words(t)) for _, t in items) / len(items)
    out = {}
    for k, (i, t) in enumerate(items):
        tf, n = Counter(words(t)), len(words(t))
        weight = {w: math.log(1 + (len(items) - df[w] + .5) / (df[w] + .5)) * c * (D.K1 + 1) /
                  (c + D.K1 * (1 - D.B + D.B * n / mean)) for w, c in tf.items()}
        whole = sum(weight.values())
        for j, (d, text) in enumerate(source):
            w = words(text)
            best = max((sum(weight.get(x, 0) for x in set(w[a:a + passage])) / whole
                        for a in range(0, max(len(w), 1), passage // 2)), default=0)
            if best >= threshold - 1e-9:
                out[(j, k)] = (str(d), i, round(best, 6))
    return sorted(out.values())


def fixture():
    r = random.Random(4)
    items = [(i, sentence(700 + i, r.randint(8, 50)).capitalize() + ".\n" + sentence(800 + i, r.randint(1, 12))) for i in range(50)]
    items += [(50, None), (51, ""), (None, "no id here"), (52, items[3][1])]
    source = []
    for i in range(120):
        parts = sentence(i, r.randint(0, 400)).split()
        if i % 3 == 0:
            leak = r.choice(items[:50])[1].split()
            a = r.randint(0, len(leak)) if i % 2 else 0
            k = r.randrange(len(parts) + 1)
            parts[k:k] = leak[a:]
        source.append((i, " ".join(parts)))
    return items, source + [(None, None), (500, ""), (501, items[1][1].upper()), (501, items[1][1].upper())]


def test_matches_exhaustive_search(spark):
    items, source = fixture()
    it = spark.createDataFrame(items, ITEMS)
    df = docs(spark, [(d, t, "", "", 0) for d, t in source])
    for shard_bytes in (1 << 20, 2000):
        D.SHARD_BYTES = shard_bytes
        try:
            rows = D.search_benchmark(df, it).collect()
        finally:
            D.SHARD_BYTES = 32 << 20
        if shard_bytes == 1 << 20:
            assert sorted((str(r.doc_id), r.item_id, round(r.score, 6)) for r in rows) == brute(source, items, D.THRESHOLD, 128)
        bad = {r.doc_id for r in rows if r.contaminated}
        whole = {d for d, t in source for i, x in items if i is not None and words(x) and
                 f" {' '.join(words(x))} " in f" {' '.join(words(t))} "}
        assert whole <= bad


def test_clean_texts_stay(spark):
    items, _ = fixture()
    clean = [(i, sentence(90_000 + i, 300)) for i in range(60)]
    rows = D.search_benchmark(docs(spark, [(d, t, "", "", 0) for d, t in clean]), spark.createDataFrame(items, ITEMS)).collect()
    assert not [r for r in rows if r.contaminated]


def test_odd_and_empty(spark):
    items, _ = fixture()
    it = spark.createDataFrame(items + [(60, odd_rows()[0][1])], ITEMS)
    rows = D.search_benchmark(docs(spark), it).collect()
    assert sorted(r.doc_id for r in rows if r.contaminated and r.item_id == 60) == [1, 2, 2]
    assert D.search_benchmark(empty(spark), it).collect() == []
    assert D.search_benchmark(docs(spark), empty(spark, ITEMS)).collect() == []


def test_query_whole_table(spark, sf_small):
    sf = sf_small.replace("0.001", "0.01")
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = D.q_op7(spark, sf).collect()
    longest = max(len(words(t)) for _, t in items)
    size = 1 << int(np.ceil(np.log2(max(128, 2 * longest))))
    assert sorted((str(r.doc_id), r.item_id, round(r.score, 6)) for r in rows) == brute(source, items, D.THRESHOLD, size)
    whole = {(d, i) for d, t in source for i, x in items if " ".join(words(x)) in " ".join(words(t))}
    assert whole and whole == {(r.doc_id, r.item_id) for r in rows if r.contaminated}
