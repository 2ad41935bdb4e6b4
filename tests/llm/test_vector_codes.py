import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from cairn.llm.catalog import QUERIES
from cairn.llm.vector_codes import Codebook, codebook_digest, compress_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, parts=16, entries=64, rounds=2):
    """{row place: (code, error)} and the final codebooks, entry by entry."""
    kept = [(i, r, [math.floor(256 * x) for x in r[1]]) for i, r in enumerate(rows)
            if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda k: (k[1][0] is None, k[1][0] or 0, k[2]))
    if not kept:
        return {}, []
    dim = len(kept[0][2])
    kept = [k for k in kept if len(k[2]) == dim]
    d = dim // parts
    books = [[k[2][p * d:(p + 1) * d] for k in kept[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            mine = [[] for _ in book]
            for _, _, q in kept:
                x = q[p * d:(p + 1) * d]
                mine[nearest(book, x)[1]].append(x)
            new.append([[sum(c) // len(xs) for c in zip(*xs)] if xs else e for e, xs in zip(book, mine)])
        books = new
    out = {}
    for i, _, q in kept:
        found = [nearest(b, q[p * d:(p + 1) * d]) for p, b in enumerate(books)]
        out[i] = ("".join(f"{n:02x}" for _, n in found), sum(x for x, _ in found))
    return out, books


@settings(max_examples=60, deadline=None)
@given(hnp.arrays(np.int64, st.tuples(st.integers(1, 20), st.integers(1, 5)), elements=st.integers(-9, 9)), st.data())
def test_search_finds_the_nearest_entry_with_the_lowest_number(entries, data):
    x = data.draw(hnp.arrays(np.int64, (7, entries.shape[1]), elements=st.integers(-12, 12)))
    code, dist, _ = Codebook(entries).nearest(x)
    all_ = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (dist == all_.min(1)).all() and (code == all_.argmin(1)).all()


def test_search_stops_early():
    rng = np.random.default_rng(1)
    entries, x = rng.integers(-500, 500, (256, 2)), rng.integers(-500, 500, (400, 2))
    _, _, computed = Codebook(entries).nearest(x)
    assert computed < 0.5 * 256 * 400


def _vectors(seed, n, dim=32):
    r = random.Random(seed)
    centres = [[r.gauss(0, .4) for _ in range(dim)] for _ in range(5)]
    return [[c + r.gauss(0, .1) for c in r.choice(centres)] for _ in range(n)]


def _rows():
    v = [[float(np.float32(x)) for x in w] for w in _vectors(3, 150)]
    rows = [(i, w, i % 4) for i, w in enumerate(v)]
    rows += [(3, v[3], 3), (3, v[3], 3), (7, v[9], None), (None, v[5], 2), (200, None, 1), (201, v[1][:-1] + [None], 1),
             (202, v[1][:-1] + [float("nan")], 1), (203, [float("inf")] + v[1][1:], None), (204, [0.0] * 32, None)]
    rows += [(300 + i, v[0], 9) for i in range(60)]  # a common vector
    return rows


def test_codes_equal_brute_force(spark):
    from pyspark.sql import functions as F
    rows = _rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", code string").repartition(5)
    df = df.withColumns({c: F.lit(1) for c in ("q", "error", "part", "entry", "n", "total", "_label")})
    got, books = compress_vectors(df)
    want, want_books = slow(rows)
    assert books.tolist() == want_books
    key = lambda t: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in t)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in got.collect()), key=key) == \
        sorted(((rows[i][0], rows[i][2], *v) for i, v in want.items()), key=key)
    text = ",".join(str(x) for p in want_books for e in p for x in e)
    assert codebook_digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_fewer_rows_than_entries_and_other_lengths(spark):
    v = [float(x) / 8 for x in range(16)]
    rows = [(1, v, 0), (2, v[::-1], 0), (3, v + v, 1), (4, [], 1), (5, [9e9] * 16, 1), (6, [3e38] * 16, 1)]
    got, books = compress_vectors(spark.createDataFrame(rows, SCHEMA))
    assert books.shape == (16, 2, 1)
    assert {r.vec_id: (r.code, r.error) for r in got.collect()} == {
        1: ("00" * 16, 0), 2: ("01" * 16, 0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_empty_table_and_only_unusable_rows(spark):
    for rows in ([], [(1, None, 0), (2, [float("nan")] * 16, 0)]):
        got, books = compress_vectors(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and books is None


def test_query_equals_brute_force_and_sums_labels(spark, tmp_path):
    rows = [r for r in _rows() if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_vector_codes"](spark, str(tmp_path)).collect()
    want, _ = slow(rows)
    by_label = {}
    for i, (_, e) in want.items():
        by_label[rows[i][2]] = by_label.get(rows[i][2], 0) + e
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == \
        sorted((rows[i][0], c, e, by_label[rows[i][2]]) for i, (c, e) in want.items())
    assert len({r.codebooks_sha256 for r in got}) == 1
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert QUERIES["op13_vector_codes"](spark, f"{tmp_path}/none").collect() == []
