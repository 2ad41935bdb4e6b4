"""Operator 1, n-gram Jaccard join with set-relation skipping.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two sets
link when ``100 * intersection >= percent * union``. Documents with equal sets
form one class, joined as one set.

1. Every task hashes its documents and deals their distinct n-grams out by hash.
   Each block counts how many sets hold an n-gram and sends those held twice or
   more back with that count. An n-gram frequent within one chunk of documents
   travels as one entry with a count, so no block gets more than an entry per
   chunk for it.
2. With n-grams ordered by count (rarest first), linked sets share one in their
   prefixes of ``n - ceil(percent * n / 100) + 1``. N-grams held once fill most
   prefixes, and sets whose prefix holds no other can link with nothing.
3. Each index list of a shared prefix n-gram is led by its smallest member. The
   lists of one leader make a *family*, so any linked pair meets in one; pairs
   are never rows. Within a family the index lists are cut into blocks by set
   size, and blocks of sizes that cannot link are skipped. A set's overlaps
   with the others are derived from those of a computed similar set: only the
   lists of n-grams in which the two sets differ are read. Families beyond
   ``FAMILY_ROWS`` are split into block pairs.
4. A family reports the links that connect its sets (at most one less than
   sets) and each set's number of links; a link met in several families is
   counted where its first common n-gram is led. Components come from
   alternating star contractions.

Hash collisions (about 2**-64 per pair) aside, the join is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import blocks_for, spread_once, table, write_stage
from cairn.llm.kernels import Words, home, mix, slices, text_buffer

WORDS, PERCENT = 4, 85
CHUNK_TOKENS = 1 << 20
HOT_IN_CHUNK = 64
FAMILY_ROWS = 256
_HOT = np.uint32(1 << 31)

DEALT = pa.schema([("dest", pa.int32()), ("chunk", pa.int64()), ("tokens", pa.binary()), ("idx", pa.binary()),
                   ("dfs", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("h1", pa.binary()),
                   ("h2", pa.binary()), ("hot", pa.binary()), ("hot_first", pa.binary()), ("hot_docs", pa.binary())])
DEALT_SQL = ("dest int, chunk long, tokens binary, idx binary, dfs binary, doc_ids array<long>, sizes binary, h1 binary, "
             "h2 binary, hot binary, hot_first binary, hot_docs binary")
SETS_SQL = "doc_id long, n long, h1 long, h2 long, k long, tokens binary"


def needed(n, percent: int):
    """Least intersection of a set of ``n`` with one it links with."""
    return (percent * n + 99) // 100


def document_sets(data: np.ndarray, offs: np.ndarray, words: int):
    """(tokens, first, h1, h2): each row's sorted distinct n-gram hashes, their
    bounds, and two order-free hashes of the set."""
    w = Words(data, offs, lower=True)
    h, at = w.windows(words)
    doc = w.doc[at] if len(at) else np.zeros(0, np.int64)
    first = np.searchsorted(doc, np.arange(len(offs)))
    for a, b in zip(first[:-1], first[1:]):
        if b - a > 1:
            h[a:b].sort()
    fresh = np.ones(len(h), bool)
    if len(h):
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    first = np.searchsorted(doc, np.arange(len(offs)))
    out = []
    for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ salt), out=sums[1:])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + salt))
    return h, first, out[0], out[1]


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _deal_task(words: int, blocks: int):
    """Documents to block rows (n-grams and the local numbers of their
    documents) and one chunk row (the documents and the n-grams frequent here)."""
    limits = (np.arange(blocks + 1, dtype=object) * (1 << 64) // blocks)[1:-1].astype(np.uint64)

    def flush(chunk: int, part: list) -> pa.RecordBatch:
        tokens = np.concatenate([p[1] for p in part])
        sizes = np.concatenate([p[2] for p in part])
        lead = np.concatenate([p[5] for p in part])
        idx = np.repeat(np.flatnonzero(lead), sizes[lead]).astype(np.uint32)
        order = np.argsort(tokens, kind="stable")
        tokens, idx = tokens[order], idx[order]
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
        runs = np.diff(np.append(start, len(tokens)))
        frequent = runs >= HOT_IN_CHUNK
        hot_first = np.append(0, np.cumsum(runs[frequent])).astype(np.int64)
        in_hot = np.repeat(frequent, runs)
        hot, hot_docs = tokens[start[frequent]], idx[in_hot]
        keep = ~in_hot
        keep[start[frequent]] = True
        idx[start[frequent]] = _HOT | runs[frequent].astype(np.uint32)
        tokens, idx = tokens[keep], idx[keep]
        bounds = np.concatenate([[0], np.searchsorted(tokens, limits), [len(tokens)]])
        rows = [{"dest": b, "chunk": chunk, "tokens": tokens[x:y].tobytes(), "idx": idx[x:y].tobytes()}
                for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])) if y > x]
        rows.append({"dest": int(home(chunk, blocks)[0]), "chunk": chunk, "doc_ids": pa.concat_arrays([p[0] for p in part]).to_pylist(),
                     "sizes": sizes.astype(np.int64).tobytes(), "h1": np.concatenate([p[3] for p in part]).tobytes(),
                     "h2": np.concatenate([p[4] for p in part]).tobytes(), "hot": hot.tobytes(),
                     "hot_first": hot_first.tobytes(), "hot_docs": hot_docs.tobytes()})
        return _rows(DEALT, rows)

    def run(batches):
        chunk, seen, part, held = TaskContext.get().partitionId() << 24, set(), [], 0
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            for lo, hi in slices(offs):
                tokens, first, h1, h2 = document_sets(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], words)
                n = np.diff(first)
                lead = np.zeros(hi - lo, bool)
                for i, key in enumerate(zip(h1.tolist(), h2.tolist())):  # copies within the task send nothing
                    if n[i] and key not in seen:
                        seen.add(key)
                        lead[i] = True
                part.append((b.column("doc_id").slice(lo, hi - lo), tokens[np.repeat(lead, n)], n, h1, h2, lead))
                held += int(n[lead].sum())
                if held >= CHUNK_TOKENS:
                    yield flush(chunk, part)
                    chunk, part, held = chunk + 1, [], 0
        if part:
            yield flush(chunk, part)
    return run


def _array(raw, dtype) -> np.ndarray:
    return np.frombuffer(raw.as_py() if hasattr(raw, "as_py") else raw, dtype)


def _count_task(blocks: int):
    """One block: n-grams held by two sets or more go back to their chunks."""
    def run(batches):
        chunks, tokens, idx = [], [], []
        for b in batches:
            plain = b.column("tokens").is_valid().to_numpy(zero_copy_only=False)
            rest = b.filter(pa.array(~plain))
            if rest.num_rows:
                dest = pa.array(home(rest.column("chunk").to_numpy(), blocks))
                yield pa.RecordBatch.from_arrays([dest, *rest.columns[1:]], schema=DEALT)
            for i in np.flatnonzero(plain):
                chunks.append(b.column("chunk")[i].as_py())
                tokens.append(_array(b.column("tokens")[i], np.uint64))
                idx.append(_array(b.column("idx")[i], np.uint32))
        if not chunks:
            return
        row = np.repeat(np.arange(len(chunks), dtype=np.int32), [len(t) for t in tokens])
        tokens, idx = np.concatenate(tokens), np.concatenate(idx)
        order = np.argsort(tokens, kind="stable")
        tokens, idx, row = tokens[order], idx[order], row[order]
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        weight = np.where(idx & _HOT, idx & ~_HOT, 1).astype(np.int64)
        df = np.add.reduceat(weight, start)
        df = np.repeat(df, np.diff(np.append(start, len(tokens))))
        keep = df >= 2
        tokens, idx, row, df = tokens[keep], idx[keep], row[keep], np.minimum(df[keep], 2**32 - 1).astype(np.uint32)
        order = np.argsort(row, kind="stable")
        tokens, idx, df = tokens[order], idx[order], df[order]
        bounds = np.searchsorted(row[order], np.arange(len(chunks) + 1))
        out = [{"dest": int(home(c, blocks)[0]), "chunk": c, "tokens": tokens[x:y].tobytes(), "idx": idx[x:y].tobytes(),
                "dfs": df[x:y].tobytes()} for c, x, y in zip(chunks, bounds[:-1], bounds[1:]) if y > x]
        for i in range(0, len(out), 500):
            yield _rows(DEALT, out[i:i + 500])
    return run


def _gather_task(percent: int):
    """One bucket of chunks: each document's shared n-grams, rarest first, and
    ``k``, how many of them lie in its prefix."""
    def run(batches):
        info, parts = {}, {}
        for b in batches:
            for r in b.to_pylist():
                if r["tokens"] is None:
                    info[r["chunk"]] = r
                else:
                    parts.setdefault(r["chunk"], []).append(r)
        for chunk, r in info.items():
            n = np.frombuffer(r["sizes"], np.int64)
            got = parts.pop(chunk, [])
            tokens = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x["tokens"], np.uint64) for x in got]])
            idx = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(x["idx"], np.uint32) for x in got]])
            df = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(x["dfs"], np.uint32) for x in got]])
            is_hot = (idx & _HOT) > 0
            if is_hot.any():  # frequent n-grams: their documents are in the chunk row
                hot, hot_first = np.frombuffer(r["hot"], np.uint64), np.frombuffer(r["hot_first"], np.int64)
                docs = np.frombuffer(r["hot_docs"], np.uint32)
                at = np.searchsorted(hot, tokens[is_hot])
                runs = np.diff(hot_first)[at]
                take = np.arange(runs.sum()) + np.repeat(hot_first[at] - (np.cumsum(runs) - runs), runs)
                tokens = np.concatenate([tokens[~is_hot], np.repeat(tokens[is_hot], runs)])
                df = np.concatenate([df[~is_hot], np.repeat(df[is_hot], runs)])
                idx = np.concatenate([idx[~is_hot], docs[take]])
            shared = np.bincount(idx, minlength=len(n))
            need = needed(n, percent)
            chosen = (shared >= need) & (n > 0) & (shared > 0)
            use = chosen[idx]
            tokens, idx, df = tokens[use], idx[use], df[use]
            order = np.lexsort((tokens, df, idx))
            tokens, idx = tokens[order], idx[order]
            bounds = np.searchsorted(idx, np.arange(len(n) + 1))
            k = np.where(chosen, shared - need + 1, 0)
            packed = [tokens[x:y].tobytes() if c else None for c, x, y in zip(chosen, bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array(n), pa.array(np.frombuffer(r["h1"], np.int64)),
                 pa.array(np.frombuffer(r["h2"], np.int64)), pa.array(k.astype(np.int64)), pa.array(packed, pa.binary())],
                names=["doc_id", "n", "h1", "h2", "k", "tokens"])
    return run


def _postings_task(batches):
    for b in batches:
        k = b.column("k").to_numpy()
        tokens = [_array(t, np.int64)[:c] for t, c in zip(b.column("tokens"), k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])), pa.array(np.repeat(b.column("node").to_numpy(), k))],
            names=["token", "node"])


def family_links(n: np.ndarray, tokens: list[np.ndarray], percent: int, side: np.ndarray | None = None):
    """Linked pairs of a family, as (set, its linked sets) per set.

    ``side``: 0 or 1 per set if only pairs of different sides count. Sets are
    taken by size; blocks of index lists whose sizes cannot link are skipped.
    """
    order = np.argsort(n, kind="stable")
    n = n[order]
    flat = np.concatenate([tokens[i] for i in order])
    rank = np.repeat(np.arange(len(n)), [len(tokens[i]) for i in order])
    _, ids = np.unique(flat, return_inverse=True)
    own = np.append(0, np.cumsum([len(tokens[i]) for i in order]))
    side = None if side is None else side[order]
    lo = 0
    while lo < len(n):  # sets lo..hi of one size block link with sets lo..far at most
        hi = int(np.searchsorted(n, max(n[lo] * 100 // percent, n[lo]), "right"))
        far = int(np.searchsorted(n, n[hi - 1] * 100 // percent, "right"))
        if far - lo > 1:
            span = slice(own[lo], own[far])
            entry = np.argsort(ids[span], kind="stable")
            lists, list_ids = rank[span][entry] - lo, ids[span][entry]
            first = np.searchsorted(list_ids, np.arange(int(ids.max()) + 2))
            length, m = np.diff(first), far - lo

            def count(of: np.ndarray) -> np.ndarray:
                sizes = length[of]
                take = np.arange(sizes.sum()) + np.repeat(first[of] - (np.cumsum(sizes) - sizes), sizes)
                return np.bincount(lists[take], minlength=m)
            base, base_counts = None, None
            for y in range(lo, hi):
                mine = np.sort(ids[own[y]:own[y + 1]])
                counts = None
                if base is not None:
                    gone, new = np.setdiff1d(base, mine, True), np.setdiff1d(mine, base, True)
                    if length[gone].sum() + length[new].sum() < length[mine].sum():
                        counts = base_counts - count(gone) + count(new)
                if counts is None:
                    counts = count(mine)
                    base, base_counts = mine, counts
                other = np.arange(y + 1 - lo, m)
                inter = counts[other]
                hit = other[100 * inter >= percent * (n[y] + n[lo + other] - inter)] + lo
                if side is not None:
                    hit = hit[side[hit] != side[y]]
                if len(hit):
                    yield order[y], order[hit]
        lo = hi


def _family_task(percent: int):
    """Families, sorted by key, to rows (a, b, copies): a link that connects
    (a, b), or a set's linked documents found here (a, null, copies)."""
    def one(leader: int, rows: dict) -> tuple[list, list, list]:
        node, n, copies = rows["node"], rows["n"], rows["copies"]
        m = len(node)
        side = None if rows["i"] == rows["j"] else rows["side"]
        label = np.arange(m)
        degree = np.zeros(m, np.int64)
        a, b = [], []
        for y, hit in family_links(n, rows["tokens"], percent, side):
            for z in hit:
                if label[z] != label[y]:
                    label[label == label[z]] = label[y]
                    a.append(int(node[y]))
                    b.append(int(node[z]))
            # a link counts in the family that leads its first common n-gram
            prefix = rows["tokens"][y][:rows["k"][y]]
            leads = rows["leads"][y]
            missing = np.ones(len(hit), bool)
            mine = np.zeros(len(hit), bool)
            for t in prefix.tolist():
                if not missing.any():
                    break
                lead = leads.get(t)
                if lead is None:
                    continue
                for p in np.flatnonzero(missing):
                    if t in rows["sets"][hit[p]]:
                        missing[p], mine[p] = False, lead == leader
            degree[y] += copies[hit[mine]].sum()
            degree[hit[mine]] += copies[y]
        at = np.flatnonzero(degree)
        return (a + node[at].tolist(), b + [None] * len(at), [None] * len(a) + degree[at].tolist())

    def finish(held: list) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        tokens = [_array(x, np.int64) for x in t.column("tokens")]
        rows = {"node": t.column("node").to_numpy(), "n": t.column("n").to_numpy(), "copies": t.column("copies").to_numpy(),
                "k": t.column("k").to_numpy(), "side": t.column("side").to_numpy(), "tokens": tokens,
                "i": t.column("i")[0].as_py(), "j": t.column("j")[0].as_py(),
                "leads": [dict(zip(x, y)) for x, y in zip(t.column("lead_tokens").to_pylist(), t.column("lead_nodes").to_pylist())],
                "sets": [set(x[:c].tolist()) for x, c in zip(tokens, t.column("k").to_pylist())]}
        a, b, c = one(t.column("leader")[0].as_py(), rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())],
                                          names=["a", "b", "copies"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("leader", "i", "j")])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for x, y in zip(bounds[:-1], bounds[1:]):
                if y == x:
                    continue
                if held and tuple(keys[x]) != key:
                    yield finish(held)
                    held = []
                key = tuple(keys[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield finish(held)
    return run


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) of the sets that occur in ``links`` (a, b); root is the
    smallest set of the component. Alternating large-star and small-star steps;
    every round is one written table."""
    edges = write_stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
                        "op1-edges")
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = write_stage(large.distinct(), "op1-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = write_stage(small, "op1-edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    documents: doc_id, n_shingles, component_id (smallest doc_id reachable by
    links, its own included), n_links (documents it links with), node (its
    class), one row per row of ``docs``. links: pairs of classes (a, b) whose sets
    link and that connect every component.

    Null, empty and blank texts have empty sets and link with nothing. Repeated
    rows and copies link with each other. Null doc_ids take part but never name
    a component unless all of it are null. An empty table gives no rows. Only
    doc_id and text are read.
    """
    blocks = blocks_for(docs)
    src = spread_once(docs.select("doc_id", "text"), "op1-rows")
    dealt = src.mapInArrow(_deal_task(words, blocks), DEALT_SQL).repartitionById(blocks, F.col("dest"))
    back = dealt.mapInArrow(_count_task(blocks), DEALT_SQL).repartitionById(blocks, F.col("dest"))
    sets = write_stage(back.mapInArrow(_gather_task(percent), SETS_SQL), "op1-sets")

    classes = write_stage(sets.filter("n > 0").groupBy("h1").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")),
                          "op1-classes")
    nodes = sets.filter("tokens is not null").select("h1", F.struct("n", "k", "tokens").alias("s")).groupBy("h1").agg(F.first("s").alias("s"))
    nodes = write_stage(nodes.join(classes.select("h1", "copies"), "h1")
                        .select(F.col("h1").alias("node"), "s.n", "s.k", "s.tokens", "copies"), "op1-nodes")

    postings = write_stage(nodes.select("node", "k", "tokens").mapInArrow(_postings_task, "token long, node long"), "op1-postings")
    lists = postings.groupBy("token").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    led = write_stage(postings.join(lists, "token"), "op1-lists")
    leads = led.groupBy("node").agg(F.collect_list(F.struct("token", "leader")).alias("l"))
    leads = leads.select("node", F.col("l.token").alias("lead_tokens"), F.col("l.leader").alias("lead_nodes"))
    members = led.select("leader", "node").distinct()
    parts = members.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / FAMILY_ROWS).cast("int").alias("p"))
    own = F.pmod(F.xxhash64("node"), F.col("p")).cast("int")
    members = members.join(parts, "leader").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    members = members.select("leader", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                             (F.col("own") > F.col("other")).cast("int").alias("side"))
    rows = members.join(nodes, "node").join(leads, "node")
    rows = rows.repartition(blocks, "leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    found = write_stage(rows.select("leader", "i", "j", "side", "node", "n", "k", "copies", "tokens", "lead_tokens", "lead_nodes")
                        .mapInArrow(_family_task(percent), "a long, b long, copies long"), "op1-links")
    links = found.filter("b is not null").select("a", "b").distinct()
    degree = found.filter("b is null").groupBy(F.col("a").alias("h1")).agg(F.sum("copies").alias("others"))

    roots = components(links)
    named = classes.join(roots, F.col("h1") == F.col("node"), "left").select("h1", "least_id", "copies",
                                                                            F.coalesce("root", "h1").alias("root"))
    named = named.join(degree, "h1", "left")
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = write_stage(named.join(names, "root").select("h1", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
                                                         .alias("n_links")), "op1-named")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("h1")).alias("node"))
    out = out.join(named.withColumnRenamed("h1", "node"), "node", "left")
    return (out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                       .alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "node"), links)


def q_op1(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))[0].drop("node")
