import math
import random
from collections import Counter

import numpy as np

from cairn.llm import perplexity as P
from tests.llm.helpers import docs, empty, odd_rows, sentence

LABELS = "doc_id long, quality int, toxic int"


def brute(trusted, texts):
    """The model by dictionaries, order by order."""
    freq = Counter(c for t in trusted for c in t)
    top = sorted(sorted(freq, key=lambda c: (-freq[c], ord(c)))[:P.SYMBOLS - 2])
    sym = {c: i + 2 for i, c in enumerate(top)}

    def coded(t):
        return [P.BORDER] * (P.ORDER - 1) + [sym.get(c, P.OTHER) for c in t]
    counts = [Counter(tuple(s[i - P.ORDER + 1:i + 1]) for s in map(coded, trusted) for i in range(P.ORDER - 1, len(s)))]
    for _ in range(P.ORDER - 1):
        counts.insert(0, Counter(g[1:] for g in counts[0]))

    def prob(g):
        k = len(g)
        c = counts[k - 1]
        n = [max(sum(v == x for v in c.values()), 1) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(x, .1), cap) for x, cap in ((1 - 2 * y * n[1] / n[0], .95), (2 - 3 * y * n[2] / n[1], 1.95),
                                                 (3 - 4 * y * n[3] / n[2], 2.95))]
        cut = lambda v: d[min(v, 3) - 1]
        below = prob(g[1:]) if k > 1 else 1 / P.SYMBOLS
        mine = [v for h, v in c.items() if h[:-1] == g[:-1]]
        if not mine:
            return below
        total = sum(mine)
        first = (c[g] - cut(c[g])) / total if g in c else 0
        return first + sum(map(cut, mine)) / total * below
    cache = {}
    out = []
    for t in texts:
        s = coded(t)
        logs = []
        for i in range(P.ORDER - 1, len(s)):
            g = tuple(s[i - P.ORDER + 1:i + 1])
            if g not in cache:
                cache[g] = math.log(max(prob(g), 1e-12))
            logs.append(cache[g])
        out.append(math.exp(-sum(logs) / len(logs)) if logs else None)
    return out


def test_matches_dictionaries(spark):
    texts = [sentence(i, 25) + " Ünï 漢" * (i % 3) for i in range(12)] + ["", "x", "#%&" * 20]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)], LABELS)
    got = {r.doc_id: r.perplexity for r in P.quality_by_perplexity(docs(spark, rows), labels).collect()}
    for i, want in enumerate(brute(texts[:8], texts)):
        assert (got[i] is None) == (want is None) and (want is None or np.isclose(got[i], want, rtol=1e-3)), i


def test_odd_and_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0), (6, 0, 0), (10, 1, 1), (10, 1, 1)], LABELS)
    rows = P.quality_by_perplexity(docs(spark), labels).collect()
    assert len(rows) == len(odd_rows())
    assert all(r.kept for r in rows if r.n_chars == 0) and all(r.kept for r in rows if r.doc_id in (1, 10))
    assert P.quality_by_perplexity(empty(spark), labels).collect() == []
    assert all(r.kept for r in P.quality_by_perplexity(docs(spark), empty(spark, LABELS)).collect())


def test_query_keeps_good_and_rejects_bad(spark, sf_small):
    sf = sf_small.replace("0.001", "0.01")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = P.q_op10(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r.kept for r in rows if quality.get(r.doc_id) == 1]) > 0.99
    assert np.mean([r.kept for r in rows if quality.get(r.doc_id) == 0]) < 0.5


def test_one_odd_trusted_row_does_not_set_the_threshold(spark):
    odd = "".join(random.Random(1).choices("qwxzvjhgfdpcsy", k=200))
    rows = [(i, sentence(i, 40), "en", "s", 1) for i in range(150)] + [(150, odd, "en", "s", 1)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(151)], LABELS)
    got = {r.doc_id: r for r in P.quality_by_perplexity(docs(spark, rows), labels).collect()}
    assert [i for i, r in got.items() if not r.kept] == [150]


def test_every_character_outside_the_symbols_has_its_share(spark):
    # 26 letters, a space and 19 capitals take the symbols; of the rest some are trusted once, some often
    common = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRS" * 6
    trusted = [common + "TUV" * 3 + "T漢" + "é", common + "W" + "T" * 4, common]
    texts = trusted + [f"abc {c} def" for c in "TVW漢éŽ"] + ["T漢Ž#" * 5]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], LABELS)
    got = {r.doc_id: r.perplexity for r in P.quality_by_perplexity(docs(spark, rows), labels).collect()}
    freq = Counter(c for t in trusted for c in t)
    rest = dict(sorted(freq.items(), key=lambda e: (-e[1], ord(e[0])))[P.SYMBOLS - 2:])
    assert len(rest) == 6

    def symbols(t):
        return [None, *("other" if c in rest or c not in freq else c for c in t)]
    pairs = Counter((b, c) for t in trusted for b, c in zip(symbols(t), t) if c in rest)

    def discount(c):
        n1, n2 = (max(sum(v == k for v in c.values()), 1) for k in (1, 2))
        return n1 / (n1 + 2 * n2)
    d, d2, total = discount(rest), discount(pairs), sum(rest.values())

    def share(b, c):
        alone = (rest[c] - d if c in rest else d * len(rest)) / total
        mine = [n for (x, _), n in pairs.items() if x == b]
        if not mine:
            return alone
        return (max(pairs[b, c] - d2, 0) + d2 * len(mine) * alone) / sum(mine)
    tops = set(freq) - set(rest)
    for i, (t, whole) in enumerate(zip(texts, brute(trusted, texts))):
        want = math.exp(math.log(whole) - sum(math.log(share(b, c)) for b, c in zip(symbols(t), t) if c not in tops) / len(t))
        assert np.isclose(got[i], want, rtol=1e-3), i
    assert got[3] < got[5] and got[5] != got[8]  # T is frequent, W is not, and the last one was never seen


def test_the_query_gives_every_character_a_symbol(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    words = ["мама", "мыла", "раму", "окно", "дом", "漢字", "Grüße", "Tür", "XVII", "1984", "#tag"]
    trusted = [" ".join(rnd.choices(words, k=30)) + " " + sentence(i, 20) + " " + "".join(map(chr, range(33 + i, 110))) for i in range(40)]
    chars = {c for t in trusted for c in t}
    assert len(chars) > P.SYMBOLS + 20
    text = " ".join(rnd.choices(words[:5], k=30))
    texts = trusted + [text, "".join(rnd.sample(text, len(text))), "字漢 ruT", "Ж" * 9, "", None]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(P, "CHUNK_BYTES", 300)
    monkeypatch.setattr(P, "CELL_BITS", 1)
    got = {r.doc_id: r.perplexity for r in P.q_op10(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    monkeypatch.setattr(P, "SYMBOLS", len(chars) + 2)
    for i, want in enumerate(brute(trusted, [t or "" for t in texts])):
        assert (got[i] is None) == (want is None) and (want is None or np.isclose(got[i], want, rtol=1e-3)), i
    assert got[40] < got[41] / 3  # words against the same characters in disorder


def test_counts_of_a_task_are_added_up(monkeypatch):
    monkeypatch.setattr(P, "HELD", 50)
    rnd = np.random.default_rng(1)
    counts, want, got = P.Counts(), Counter(), Counter()
    for _ in range(30):
        context, char = rnd.integers(0, 4, 40) << 40, rnd.integers(0, 30, 40)
        want.update(zip(context.tolist(), char.tolist()))
        if counts.add(context, char):
            for b in counts.take():
                got.update({(r["context"], r["char"]): r["c"] for r in b.to_pylist()})
    for b in counts.take():
        got.update({(r["context"], r["char"]): r["c"] for r in b.to_pylist()})
    assert got == want
