import itertools
import zlib

import numpy as np

from cairn.llm.toxicity import marginals, q_op4, toxicity
from tests.llm.helpers import docs, empty, odd_rows, sentence

LABELS = "doc_id long, quality int, toxic int"


def test_forward_backward():
    rng = np.random.default_rng(2)
    length = np.array([1, 4, 6])
    emit = np.where(np.arange(6) < length[:, None], rng.normal(size=(3, 6)), 0)
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    m, pair, z = marginals(emit, length, trans, start)
    for k, n in enumerate(length):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        s = np.array([start[p[0]] + sum(emit[k, t] * p[t] for t in range(n)) + sum(trans[p[t], p[t + 1]] for t in range(n - 1))
                      for p in paths])
        prob = np.exp(s - s.max())
        prob /= prob.sum()
        assert np.allclose(m[k, :n], [sum(q for q, p in zip(prob, paths) if p[t]) for t in range(n)])
        assert np.isclose(z[k], np.log(np.exp(s).sum()))
        want = np.zeros((2, 2))
        for q, p in zip(prob, paths):
            for t in range(n - 1):
                want[p[t], p[t + 1]] += q
        assert np.allclose(pair[k], want)


def table(n=600):
    rows, labels = [], []
    bad = ["vilo", "grubzak", "grubzam", "grubzir", "Nastor"]
    for i in range(n):
        w = sentence(i, 80).split()
        toxic = int(i % 6 == 0)
        if toxic:
            for k in range(1 + i % 3):
                w[(i * 7 + k * 11) % 80] = bad[(i // 6 + k) % 5] + ("q" if i % 12 == 0 and (i // 6 + k) % 5 in (1, 2, 3) else "")
        rows.append((i, " ".join(w[:40]) + "\n" + " ".join(w[40:]), "en", "s", 1))
        labels.append((i, 1, toxic))
    return rows, labels


def test_learns_words_and_stems(spark):
    rows, labels = table()
    rows += [(9000, "grubzaxxxx " + sentence(1, 30), "en", "s", 1), (9001, sentence(2, 30), "en", "s", 1), (9002, None, "en", "s", 1),
             (9003, sentence(3, 30_000), "en", "s", 1)]
    lab = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 4 != 2], LABELS)
    out = {r.doc_id: r for r in toxicity(docs(spark, rows), lab).collect()}
    truth = {i: t for i, _, t in labels}
    assert np.mean([(out[i].score >= 0.3) == bool(t) for i, t in truth.items()]) > 0.98
    assert out[9000].score > 0.3 > out[9001].score and out[9002].score <= out[9001].score
    assert out[9003].score < 0.3  # length is no evidence
    text = dict((r[0], r[1]) for r in rows)[0].encode()
    found = {text[s["from"]:s["to"]].decode().lower().split()[0][:4] for s in out[0].spans}
    assert found and found <= {"vilo", "grub", "nast"}


def test_held_out_rows_are_not_used(spark):
    rows, labels = table(240)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a = toxicity(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    b = toxicity(docs(spark, rows), spark.createDataFrame(flip, LABELS)).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_odd_and_empty(spark):
    _, labels = table(60)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (5, 1, 0)], LABELS)
    assert toxicity(docs(spark), lab).count() == len(odd_rows())
    assert toxicity(empty(spark), lab).collect() == []
    out = toxicity(docs(spark), empty(spark, LABELS)).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r.score < 0.3 for r in out)


def test_query_held_out_accuracy(spark, sf_small):
    sf = sf_small.replace("0.001", "0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = q_op4(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) > 0.93
    assert not [1 for p, t in held if p and not t]
