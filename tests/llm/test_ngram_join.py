import random

import numpy as np

from cairn.llm import ngram_join as J
from tests.llm.helpers import WORD, docs, empty, lower_az, odd_rows, sentence


def brute(source, words, percent):
    sets = []
    for _, t in source:
        w = WORD.findall(lower_az(t or ""))
        sets.append(frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words
                    else frozenset([tuple(w)]) if w else frozenset())
    root, degree = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if inter and 100 * inter >= percent * (len(a) + len(sets[j]) - inter):
                root[find(i)] = find(j)
                degree[i] += 1
                degree[j] += 1
    groups = {}
    for i, (d, _) in enumerate(source):
        groups.setdefault(find(i), []).append(d)
    least = {g: min([d for d in v if d is not None], default=None) for g, v in groups.items()}
    return sorted((str(d), len(sets[i]), str(d if not sets[i] else least[find(i)]), degree[i]) for i, (d, _) in enumerate(source))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in df.collect())


def near_copies():
    r = random.Random(3)
    rows, base = [], [sentence(100 + k, 150).split() for k in range(5)]
    for i in range(260):
        w = base[i % 5][:]
        for _ in range(r.choice([0, 0, 1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = f"e{r.randrange(40)}"
        if i % 7 == 0:
            w = w[:r.randrange(1, len(w))]
        rows.append((1000 - i, " ".join(w)))
    shared = " ".join(sentence(999, 40).split())
    return rows + [(2000 + i, sentence(5000 + i, r.randrange(5, 80)) + " " + shared) for i in range(80)]


def test_odd_rows(spark):
    source = [(r[0], r[1]) for r in odd_rows()]
    for words, percent in ((4, 85), (5, 80)):
        assert got(J.ngram_join(docs(spark), words, percent)[0]) == brute(source, words, percent)


def test_near_copies(spark, monkeypatch):
    source = near_copies()
    df = docs(spark, [(d, t, "", "", 0) for d, t in source])
    for words, percent in ((4, 85), (5, 60)):
        assert got(J.ngram_join(df, words, percent)[0]) == brute(source, words, percent)
    monkeypatch.setattr(J, "FAMILY_ROWS", 16)  # families split into block pairs
    monkeypatch.setattr(J, "HOT_IN_CHUNK", 3)  # n-grams that travel as counts
    monkeypatch.setattr(J, "CHUNK_TOKENS", 2000)
    assert got(J.ngram_join(df, 4, 85)[0]) == brute(source, 4, 85)


def test_family_derivation():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 10**6, 200)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(100, 200), replace=False), rng.integers(0, 10**6, 5)]))
            for _ in range(60)]
    n = np.array([len(s) for s in sets])
    pairs = {tuple(sorted((int(y), int(z)))) for y, hit in J.family_links(n, sets, 70) for z in hit}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))}
    assert pairs == want and want


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.range(500, 520).selectExpr("id as a", "id as b"))
    rows = {r.node: r.root for r in J.components(chain).collect()}
    assert rows == {i: 0 for i in range(1, 201)}


def test_empty(spark):
    assert J.ngram_join(empty(spark))[0].collect() == []


def test_query_whole_table(spark, sf_small):
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert got(J.q_op1(spark, sf_small)) == brute(source, 4, 85)


def test_dealt_rows_are_written_before_counting(spark, tmp_path, monkeypatch):
    """A task that runs again must see its rows in the same order: none is read
    from a round-robin exchange."""
    from cairn.llm import ngram_join as N
    source = [(i, sentence(i % 7, 40)) for i in range(30)]
    spark.createDataFrame(source, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    plans = {}

    def spy(df, name, write=N.write_stage):
        plans[name] = df._jdf.queryExecution().toString()
        return write(df, name)
    monkeypatch.setattr(N, "write_stage", spy)
    out, _ = N.ngram_join(spark.read.parquet(f"{tmp_path}/d"))
    assert "RoundRobin" not in plans["op1-sets"]
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(i, i % 7) for i in range(30)}
