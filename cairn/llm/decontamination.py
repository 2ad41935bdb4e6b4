"""Operator 7, benchmark decontamination: a BM25 index with block-max WAND.

The benchmark's items are indexed by term; a posting's impact is its BM25
weight divided by the item's score for its own text, so a passage that holds
an item whole reaches 1 and one threshold serves all items. Items lie in
blocks, and every term keeps its largest impact per block and overall.

Every document is cut into overlapping passages, each of which is a query. The
terms of smallest influence whose impacts sum up to less than half the
threshold in any item are set aside (they cannot lift an item over it alone); a
passage is dropped when the overall bounds of its other terms stay under the
rest of the threshold, a block when its bounds do, an item of the remaining
blocks when its own impacts do, and what is left is scored whole. The passages
of a slice take each step together. All pairs at or above the threshold are
found. A pair is contaminated if the document, around the passage, holds at least
``overlap`` of the word n-grams of the item's question and of its answer.

The index is built and broadcast in shards of at most ``SHARD_BYTES`` of item
text, one scan of the documents each; term statistics are those of all items.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import spread_text, table
from cairn.llm.kernels import Words, slices, text_buffer

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.6
WORDS = 5
BLOCK_ITEMS = 16
SHARD_BYTES = 32 << 20
MIN_PASSAGE = 128

OUT = ("doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage long, "
       "contaminated boolean")


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last line; of a single line, its last sentence; of a
    single sentence, its last third of words."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    sentences = re.split(r"(?<=[.?!])\s+", text.strip())
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3)
    return (" ".join(words[:cut]), " ".join(words[cut:])) if cut else (text, text)


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the hashes of the text's distinct n-grams (of the whole,
    if it is shorter)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]))
    return w.hash, np.unique(w.windows(min(WORDS, max(1, len(w.hash))))[0])


class Index:
    """The items of one shard; ``df``: term hash to number of items overall."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], total: int, mean_words: float):
        self.ids = np.array([i for i, _ in items], np.int64)
        rows = []
        self.parts, self.sizes, longest = [], [], 1
        for k, (_, text) in enumerate(items):
            words, _ = hashed(text)
            longest = max(longest, len(words))
            terms, tf = np.unique(words, return_counts=True)
            n = np.array([df[int(t)] for t in terms], float)
            weight = np.log(1 + (total - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (
                tf + K1 * (1 - B + B * len(words) / max(mean_words, 1e-9)))
            if len(terms):
                rows.append((np.full(len(terms), k), terms, weight / weight.sum()))
            q, a = question_and_answer(text)
            parts = []
            for part in (q, a):
                n_words = len(hashed(part)[0])
                parts.append((min(WORDS, max(1, n_words)), hashed(part)[1] if n_words else np.zeros(0, np.uint64)))
            self.parts.append(parts)
            self.sizes.append(len(words))
        item, term, impact = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, t)
                              for k, t in ((0, np.int64), (1, np.uint64), (2, float)))
        self.terms, tid = np.unique(term, return_inverse=True)
        order = np.lexsort((item, tid))
        self.item, self.impact, tid = item[order], impact[order], tid[order]
        self.first = np.searchsorted(tid, np.arange(len(self.terms) + 1))
        block = self.item // BLOCK_ITEMS
        new = np.append(True, (tid[1:] != tid[:-1]) | (block[1:] != block[:-1])) if len(tid) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        self.block, self.block_max = block[start], np.maximum.reduceat(self.impact, start) if len(start) else np.zeros(0)
        self.block_first = np.searchsorted(tid[start], np.arange(len(self.terms) + 1))
        self.max = np.maximum.reduceat(self.impact, self.first[:-1]) if len(self.terms) else np.zeros(0)
        self.passage = 1 << int(np.ceil(np.log2(max(MIN_PASSAGE, 2 * longest))))
        # terms set aside: most common first, while no item gets half the threshold from them
        mass, self.aside, self.slack = np.zeros(len(items)), np.zeros(len(self.terms), bool), 0.0
        for t in np.argsort(-np.diff(self.first), kind="stable"):
            span = slice(self.first[t], self.first[t + 1])
            mass[self.item[span]] += self.impact[span]
            if mass[self.item[span]].max() >= THRESHOLD / 2:
                mass[self.item[span]] -= self.impact[span]
                break
            self.aside[t] = True
        self.slack = float(mass.max()) if len(mass) else 0.0
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
            hit = self.terms[at] == hashes[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Items of the shard that reach ``threshold`` for distinct terms:
        blocks whose bound stays below are skipped."""
        span = [slice(self.block_first[t], self.block_first[t + 1]) for t in terms]
        blocks = np.concatenate([self.block[s] for s in span])
        bound = np.bincount(blocks, np.concatenate([self.block_max[s] for s in span]))
        good = bound >= threshold - 1e-9
        if not good.any():
            return []
        span = [slice(self.first[t], self.first[t + 1]) for t in terms]
        items, impact = np.concatenate([self.item[s] for s in span]), np.concatenate([self.impact[s] for s in span])
        keep = good[items // BLOCK_ITEMS]
        score = np.bincount(items[keep], impact[keep], minlength=1)
        return [(int(i), float(score[i])) for i in np.flatnonzero(score >= threshold - 1e-9)]


def find(index: Index, w: Words, rows: int, threshold: float, overlap: float):
    """(row, item, score, question overlap, answer overlap, passage) of a slice."""
    term = index.lookup(w.hash)
    step = index.passage // 2
    vital = np.flatnonzero(term >= 0)
    vital = vital[~index.aside[term[vital]]]
    if not len(vital):
        return []
    # passage p of a row holds its words [p * step, p * step + passage)
    local = vital - w.first[:-1][w.doc[vital]]
    base = np.append(0, np.cumsum(w.count // step + 1))  # number of a row's first passage
    both = np.concatenate([local // step, local // step - 1])
    use = both >= 0
    number = (base[np.tile(w.doc[vital], 2)] + both)[use]
    key = np.unique(number * len(index.terms) + np.tile(term[vital], 2)[use])
    p, t = key // len(index.terms), key % len(index.terms)
    need = threshold - index.slack - 1e-9

    def reaching(group: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Groups whose weights sum up to what is needed."""
        uniq, inverse = np.unique(group, return_inverse=True)
        return uniq[np.bincount(inverse, weight, minlength=len(uniq)) >= need]

    def spread(first: np.ndarray, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, entry) for the index entries of each passage's terms."""
        size = first[t + 1] - first[t]
        return np.repeat(p, size), np.arange(size.sum()) + np.repeat(first[t] - (np.cumsum(size) - size), size)
    alive = np.isin(p, reaching(p, index.max[t]))  # bounds of the passage
    p, t = p[alive], t[alive]
    q, entry = spread(index.block_first, p, t)  # bounds of its blocks
    blocks = int(index.item.max()) // BLOCK_ITEMS + 1
    good = reaching(q * blocks + index.block[entry], index.block_max[entry])
    alive = np.isin(p, good // blocks)
    q, entry = spread(index.first, p[alive], t[alive])
    item = index.item[entry]
    alive = np.isin(q * blocks + item // BLOCK_ITEMS, good)
    items = len(index.ids)
    chosen = np.unique(reaching(q[alive] * items + item[alive], index.impact[entry[alive]]) // items)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for number in chosen.tolist():
        d = int(np.searchsorted(base, number, "right")) - 1
        p = number - int(base[d])
        a = w.first[d] + p * step
        b = min(a + index.passage, w.first[d + 1])
        for item, score in index.search(np.unique(term[a:b][term[a:b] >= 0]), threshold):
            if score > best.get((d, item), (-1.0, 0))[0]:
                best[(d, item)] = (score, int(p))
    out, grams = [], {}
    for (d, item), (score, p) in best.items():
        a = max(w.first[d], w.first[d] + p * step - index.sizes[item])
        b = min(w.first[d] + p * step + index.passage + index.sizes[item], w.first[d + 1])
        shares = []
        for n, need in index.parts[item]:
            if n not in grams:
                grams[n] = w.windows(n)
            h, at = grams[n]
            here = h[np.searchsorted(at, a):np.searchsorted(at, b)]
            shares.append(float(np.isin(need, here).mean()) if len(need) else 1.0)
        out.append((int(d), int(index.ids[item]), score, shares[0], shares[1], p, min(shares) >= overlap))
    return out


def _search_task(held, threshold: float, overlap: float):
    def run(batches):
        index = held.value
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            for lo, hi in slices(offs):
                w = Words(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                found = find(index, w, hi - lo, threshold, overlap)
                ids = b.column("doc_id").slice(lo, hi - lo)
                cols = list(zip(*found)) if found else [[]] * 7
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64())), *[pa.array(c, k) for c, k in zip(cols[1:], kinds)]],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage", "contaminated"])
    return run


def _stats_task(batches):
    for b in batches:
        n, terms = [], []
        for t in b.column("text").to_pylist():
            words = hashed(t or "")[0]
            n.append(len(words))
            terms.append(np.unique(words).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["n", "terms"])


def search_benchmark(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Rows, one per document row and item retrieved: doc_id, item_id, score
    (share of the item's BM25 score for itself), question_overlap,
    answer_overlap, passage (the best one's number), contaminated.

    Items with a null or empty text are never found; items without an id are
    dropped, repeated items found each. Null and empty documents find nothing;
    a null doc_id is kept. Empty tables give no rows. Only doc_id and text, and
    item_id and text, are read.
    """
    spark = docs.sparkSession
    items = items.filter("item_id is not null and text is not null").select("item_id", "text")
    stats = items.mapInArrow(_stats_task, "n long, terms array<long>")
    total, mean = stats.filter("n > 0").agg(F.count(F.lit(1)), F.avg("n")).first()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not total:
        return spark.createDataFrame([], OUT)
    shards = -(-size // SHARD_BYTES)
    df = stats.select(F.explode("terms").alias("term")).groupBy("term").count()
    src, found = spread_text(docs.select("doc_id", "text")), None
    for k in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        rows = sorted((r.item_id, r.text) for r in part.collect())
        own = df
        if shards > 1:
            own = df.join(part.mapInArrow(_stats_task, "n long, terms array<long>").select(F.explode("terms").alias("term")),
                          "term", "left_semi")
        counts = {r.term & 0xFFFFFFFFFFFFFFFF: r["count"] for r in own.collect()}
        held = spark.sparkContext.broadcast(Index(rows, counts, total, mean))
        one = src.mapInArrow(_search_task(held, threshold, overlap), OUT)
        found = one if found is None else found.unionByName(one)
    return found


def q_op7(spark, sf_dir: str) -> DataFrame:
    return search_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
