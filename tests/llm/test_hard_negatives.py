import math
import random

import numpy as np
import pytest

from cairn.llm import hard_negatives as H
from cairn.llm.catalog import QUERIES
from cairn.llm.hard_negatives import Group, Rows, angles, mine_hard_negatives, unit

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, positives=5, negatives=5, low=80, high=100):
    """``rows``: (vec_id, label, integers), all taking part."""
    rows = sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0))
    out = []
    for a, (aid, alabel, aq) in rows:
        if aid is None or aid % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(aq, q)), n, vid, label) for n, (c, (vid, label, q)) in enumerate(rows)
                  if c != a and len(q) == len(aq)]
        scored.sort(key=lambda s: s[:2])
        for p, _, pid, _ in [s for s in scored if s[3] == alabel][:positives]:
            fit = [s for s in scored if s[3] != alabel and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(aid, pid, r + 1, nid, -p, -s) for r, (s, _, nid, _) in enumerate(fit)]
    return sorted(out, key=str)


def _vectors(n, dim=8, seed=5):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [[float(np.float32(c + r.gauss(0, .4))) for c in r.choice(centres)] for _ in range(n)]


def _query_rows():
    v = _vectors(900)
    rows = [(i, x, i * 7 % 3) for i, x in enumerate(v)]
    rows += [(2000 + i, v[200], i % 2) for i in range(300)]  # a common vector, with anchors among its rows
    rows += [(100, v[100], 1), (100, v[100], 1), (5, v[3], 2), (400, v[4], None), (None, v[0], 1), (None, v[0], 0),
             (500, None, 1), (700, v[1][:-1] + [None], 1), (800, v[1][:-1] + [float("nan")], 1), (1100, [0.0] * 8, 1), (1200, [0.0] * 8, 0),
             (1300, v[0] + v[1], 1), (1301, v[2] + v[1], 1), (1302, v[0] + v[3], 0), (1400, [], 2), (1401, [], 2), (1402, [], 0)]
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    from pyspark.sql import functions as F
    rows = _query_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.withColumns({c: F.lit(1) for c in ("q", "row", "kind", "cluster", "anchor", "rank", "score", "group", "positives")}) \
        .write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    used = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = slow(used)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) > 200


def test_empty_table_and_no_anchor(spark, tmp_path):
    for name, rows in (("a", []), ("b", [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1)]), ("c", [(100, [1.0, 2.0], 0)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert QUERIES["op12_hard_negatives"](spark, f"{tmp_path}/{name}").collect() == []


def test_other_bands_and_numbers(spark):
    v = _vectors(300, 6, 9)
    rows = [(i, i % 4, [math.floor(50 * x) for x in x_]) for i, x_ in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, label long, q array<int>")
    got = mine_hard_negatives(df, df.vec_id % 100 == 0, positives=3, negatives=7, low=50, high=120)
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows, 3, 7, 50, 120)


def _rows(q, label):
    n = len(q)
    return Rows(q, np.asarray(label), np.arange(n), np.zeros(n, bool), np.arange(n))


def test_list_is_left_once_the_answer_is_certain():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    near = (200 * (centre + rng.normal(0, .15, (3000, 16)))).astype(np.int64)
    far = (200 * rng.normal(0, .5, (30_000, 16))).astype(np.int64)
    g = Group(_rows(np.concatenate([far, near]), [1] * 33_000))
    members = Rows(near[:20], np.ones(20, int), np.arange(20), np.zeros(20, bool), np.arange(30_000, 30_020))
    c = unit(centre[None])[0][0]
    g.sort_for(c, float(angles(unit(members.q)[0], c).max()))
    everything = np.full(20, np.iinfo(np.int64).max)
    i, place, score = g.walk(members, np.arange(20), -everything, everything, True, 5)
    assert g.scored < 0.25 * 20 * 33_000
    full = near[:20] @ g.rows.q.T
    for m in range(20):
        s = full[m].copy()
        s[30_000 + m] = np.iinfo(np.int64).min
        assert sorted(score[i == m], reverse=True) == sorted(s, reverse=True)[:5]


@pytest.mark.parametrize("radius", [0.0, 0.7, math.pi])
def test_bound_holds_for_every_member_in_the_radius(radius):
    rng = np.random.default_rng(3)
    q = rng.integers(-100, 100, (500, 4))
    g = Group(_rows(q, [0] * 500))
    c = unit(rng.normal(size=(1, 4)))[0][0]
    g.sort_for(c, radius)
    units, norm = unit(g.rows.q)
    inside = angles(units, c) <= radius
    score = g.rows.q[inside] @ g.listed.q.T
    assert (score <= norm[inside][:, None] * g.bound[None] + H.MARGIN * (norm.max() ** 2 + 1)).all()
    assert (np.diff(g.bound) <= 0).all()
