import hashlib
import random
from collections import Counter

from cairn.llm import suffix_dedup as S
from tests.llm.helpers import docs, empty, odd_rows, sentence


def brute(source, length):
    texts = [(d, (t or "").encode()) for d, t in source]
    count = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = [(i, next((j for j in range(i, len(t)) if not gone[j]), len(t)))
                 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((str(d), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], r.kept_sha256, bytes(r.kept)) for r in df.collect())


def hard(seed, n=120):
    r = random.Random(seed)
    passages = [sentence(seed * 50 + k, r.randint(3, 60)) for k in range(8)]
    rows = []
    for i in range(n):
        parts = [sentence(9000 + seed * 1000 + i, r.randint(0, 12))]
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            parts.append(p[a:a + r.randint(1, 400)])
        rows.append((i, "".join(parts)))
    rows.append((n, "ab" * 300))
    rows.append((n + 1, "x" * 150 + "é" * 90))
    return rows


def test_odd_rows(spark):
    source = [(r[0], r[1]) for r in odd_rows() if r[0] != 10]
    for length in (40, 41, 400):
        assert got(S.suffix_dedup(docs(spark, [r for r in odd_rows() if r[0] != 10]), length)) == brute(source, length)


def test_overlapping_repeats(spark, monkeypatch):
    for seed, length, chunk in ((1, 60, 1 << 20), (2, 61, 2000), (3, 100, 700)):
        monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
        source = hard(seed)
        df = docs(spark, [(d, t, "", "", 0) for d, t in source]).repartition(3)
        assert got(S.suffix_dedup(df, length)) == brute(source, length)


def test_empty(spark):
    assert S.suffix_dedup(empty(spark)).collect() == []


def test_query_whole_table(spark, sf_small):
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = [(d, n, g, len(s), h) for d, n, g, s, h, _ in brute(source, 400)]
    rows = S.q_op5(spark, sf_small).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    assert sum(r.n_removed for r in rows) > 0


def test_row_order_may_differ_between_scans(spark):
    """Several chunks from a table whose rows come in another order in every scan."""
    r = random.Random(5)
    passages = ["%0600x" % r.getrandbits(2400) for _ in range(1200)]
    rows = [(i, f"{'%02000x' % r.getrandbits(8000)}{'[{'[i % 2]}{passages[i // 2]}{']}'[i % 2]}{'%02000x' % r.getrandbits(8000)}")
            for i in range(2400)]

    def shuffled(batches):
        import os

        import pyarrow as pa
        t = pa.Table.from_batches(batches)
        order = list(range(t.num_rows))
        random.Random(os.urandom(8)).shuffle(order)
        yield from t.take(order).combine_chunks().to_batches(max_chunksize=100)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(shuffled, "doc_id long, text string")
    out = S.suffix_dedup(df, with_text=False).collect()
    assert sorted(x.doc_id for x in out) == list(range(2400))
    assert {(x.n_removed, tuple(x.spans[0]) if x.spans else None) for x in out} == {(600, (2001, 2601))}
