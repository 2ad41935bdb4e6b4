import zlib
from collections import defaultdict

from cairn.llm.sharding import greedy, q_op8, shard_documents, smallest_capacity
from tests.llm.helpers import docs, empty, odd_rows, sentence


def best_capacity(sizes, shards):
    """Dynamic programme over all contiguous partitions."""
    inf = float("inf")
    best = [0] + [inf] * len(sizes)
    for _ in range(shards):
        new = best[:]
        for j in range(1, len(sizes) + 1):
            total = 0
            for i in range(j, 0, -1):
                total += sizes[i - 1]
                new[j] = min(new[j], max(best[i - 1], total))
        best = new
    return best[-1]


def test_capacity_is_optimal():
    import random
    for seed in range(20):
        r = random.Random(seed)
        sizes = [r.choice([1, 2, 5, 40]) for _ in range(r.randint(1, 25))]
        got = smallest_capacity(sizes, 4, max(sizes))
        assert got == best_capacity(sizes, 4)
        assert len(greedy(sizes, got)) <= 4


def check(rows, source, shards):
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in source)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows) == want
    slots, sizes, homes = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[(r.size, r.text_crc32)].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    return sizes


def test_odd_rows(spark):
    rows = shard_documents(docs(spark), 4).collect()
    check(rows, [(r[0], r[1]) for r in odd_rows()], 4)


def test_hot_group_and_optimum(spark):
    import hashlib
    source = [(i, sentence(i % 300, 5 + i % 40)) for i in range(900)] + [(i, "hot " * 30) for i in range(900, 1300)]
    rows = shard_documents(docs(spark, [(i, t, "en", "s", 1) for i, t in source]), 16).collect()
    sizes = check(rows, source, 16)
    groups = defaultdict(int)
    for _, t in source:
        groups[hashlib.md5(t.encode()).hexdigest()] += len(t.encode()) + 1
    ordered = [groups[k] for k in sorted(groups)]
    assert max(sizes.values()) == rows[0].capacity == best_capacity(ordered, 16)


def test_empty(spark):
    assert shard_documents(empty(spark)).collect() == []


def test_query_whole_table(spark, sf_small):
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    sizes = check(q_op8(spark, sf_small).collect(), source, 16)
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + max(len((t or "").encode()) + 1 for _, t in source) * 3
