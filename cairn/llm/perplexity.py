"""Operator 10, quality classifier: interpolated modified Kneser-Ney.

A character n-gram model (order ``ORDER``) is trained on the trusted text: the documents
labelled good. Every character of the trusted text is a symbol of its own; those that it never has share what is
left. Counting is sharded: every task counts its n-grams, the counts are summed by n-gram, and continuation
counts come from the counts of the order above. Every trusted document is counted, so the model grows with the input.

Documents are scored by joins: they are dealt into chunks, each chunk gives its different n-grams, their
probabilities come from joins with the counts of each order, lowest first, and go back to the chunk, where a
document's perplexity is one lookup per character. A document is rejected if its perplexity is above the ``QUANTILE``
of the trusted documents of its language (of all of them, if the language has
fewer than ``MIN_TRUSTED``; the largest, if all are fewer).

With a number of ``symbols`` the model knows that many instead (the most frequent characters, a border and one class of all others).
A character of that class has the class's probability times its own
share in it after the symbol before (interpolated with its share in all), from the counts of all
characters; only those that the trusted text never has count as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checked_broadcast, spread_text, table, with_rows, write_stage
from cairn.llm.kernels import mix, slices, text_buffer

ORDER, SYMBOLS = 4, 48
QUANTILE = 0.995
MIN_TRUSTED = 50
BITS = 21
POINTS = 1 << BITS
BORDER, OTHER = 0x110000, 0x110001
"""Beyond all code points."""
HELD = 1 << 20
"""N-grams that a task holds before it adds them up."""
CHUNK_BYTES, CELL_BITS = 32 << 20, 6
"""Text of a chunk; rows are taken 2 ** CELL_BITS at a time."""


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts of a slice and each row's first one."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        return points, heads[offs]
    except UnicodeDecodeError:  # broken bytes become replacement characters
        rows = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offs[:-1], offs[1:])]
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)


def grams(points: np.ndarray, first: np.ndarray, symbols: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at every character: the ``ORDER - 1`` characters before it, packed with the nearest one
    lowest, and the character; a text is preceded by borders. Of ``symbols``, sorted code points, all others are OTHER; without, none is."""
    ids = points.astype(np.int64)
    if symbols is not None:
        at = np.minimum(np.searchsorted(symbols, points), max(len(symbols) - 1, 0))
        ids[symbols[at] != points if len(symbols) else slice(None)] = OTHER
    place = np.arange(len(points)) - np.repeat(first[:-1], np.diff(first))
    context = np.zeros(len(ids), np.int64)
    for k in range(1, ORDER):
        before = np.zeros(len(ids), np.int64)
        before[k:] = ids[:-k] if len(ids) > k else before[k:]
        before[place < k] = BORDER
        context |= before << BITS * (k - 1)
    return context, ids


def numbers(context: np.ndarray, char: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, which stand for them within a task."""
    return mix(mix(context.view(np.uint64)) ^ char.astype(np.uint64))


def tally(context: np.ndarray, char: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each n-gram once, with its sum of ``n``."""
    if not len(n):
        return context, char, n
    key = numbers(context, char)
    order = np.argsort(key)
    key = key[order]
    at = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
    return context[order[at]], char[order[at]], np.add.reduceat(n[order], at)


class Counts:
    """Counts of n-grams, added up in a task."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, context: np.ndarray, char: np.ndarray, n: np.ndarray | None = None) -> bool:
        """True if there are many different ones, so that they should be taken."""
        self.parts.append(tally(context, char, np.ones(len(char), np.int64) if n is None else n))
        self.size += len(self.parts[-1][0])
        if self.size > HELD:
            self.parts = [tally(*map(np.concatenate, zip(*self.parts)))]
            self.size = len(self.parts[0][0])
        return self.size > HELD // 2

    def take(self, chunk: int | None = None):
        """All of them in batches, of a chunk without their counts."""
        context, char, n = tally(*map(np.concatenate, zip(*self.parts))) if self.parts else [np.zeros(0, np.int64)] * 3
        self.parts, self.size = [], 0
        order = np.argsort(context)
        for i in range(0, len(order), 100_000):
            at = order[i:i + 100_000]
            if chunk is None:
                yield pa.RecordBatch.from_arrays([pa.array(context[at]), pa.array(char[at]), pa.array(n[at])], names=["context", "char", "c"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk, np.int64)), pa.array(context[at]), pa.array(char[at])],
                                                 names=["chunk", "context", "char"])


def _points_task(batches):
    for b in batches:
        data, offs = text_buffer(b.column("text"))
        for lo, hi in slices(offs):
            point, n = np.unique(characters(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(point.astype(np.int64)), pa.array(n)], names=["point", "n"])


def _grams_task(symbols: np.ndarray | None):
    """Counts of n-grams, and under negative contexts those of the pairs of characters without a symbol of their own."""
    def run(batches):
        counts = Counts()
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            for lo, hi in slices(offs):
                points, first = characters(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                context, char = grams(points, first, symbols)
                rare = char == OTHER
                if rare.any():
                    counts.add(-1 - (context[rare] & POINTS - 1), points[rare].astype(np.int64))
                if counts.add(context, char):
                    yield from counts.take()
        yield from counts.take()
    return run


def _slices(batches, starts: np.ndarray):
    """(chunk, rows) of the texts of a task, a slice at a time."""
    for b in batches:
        chunk = np.searchsorted(starts, b.column("row").to_numpy(), "right") - 1
        for c in np.unique(chunk):
            rows = b.filter(pa.array(chunk == c))
            for lo, hi in slices(text_buffer(rows.column("text"))[1]):
                yield int(c), rows.slice(lo, hi - lo)


def _slice_grams(rows: pa.RecordBatch | pa.Table, symbols: np.ndarray | None) -> tuple[np.ndarray, ...]:
    data, offs = text_buffer(rows.column("text"))
    points, first = characters(data, offs)
    return points, first, *grams(points, first, symbols)


def _seen_task(starts: np.ndarray, symbols: np.ndarray | None):
    """The different n-grams of every chunk."""
    def run(batches):
        counts, of = Counts(), None
        for chunk, rows in _slices(batches, starts):
            if chunk != of and of is not None:
                yield from counts.take(of)
            of = chunk
            if counts.add(*_slice_grams(rows, symbols)[2:]):
                yield from counts.take(of)
        if of is not None:
            yield from counts.take(of)
    return run


def _texts_task(starts: np.ndarray):
    """The texts of every chunk, packed a slice at a time."""
    def run(batches):
        for chunk, rows in _slices(batches, starts):
            sink, rows = pa.BufferOutputStream(), rows.select(["doc_id", "text", "lang"])
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             names=["chunk", "rows"])
    return run


def chunk_starts(rows: DataFrame) -> np.ndarray:
    """The first row of every chunk: rows of a file that follow one another, about CHUNK_BYTES of text, less
    if there were too few for the cores. ``rows`` as numbered by :func:`with_rows`, so chunks are alike in every job."""
    cell = F.shiftright("row", CELL_BITS).alias("cell")
    cells = write_stage(rows.groupBy(cell).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size")), "op10-cells")
    cells = cells.withColumn("file", F.shiftright("cell", 36 - CELL_BITS))
    total = cells.agg(F.sum("size")).first()[0] or 0
    size = max(1, min(CHUNK_BYTES, total // rows.sparkSession.sparkContext.defaultParallelism))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = cells.withColumn("chunk", F.floor(before / size)).groupBy("file", "chunk").agg(F.min("cell").alias("cell")).select("cell").collect()
    return np.sort(np.array([r.cell for r in found], np.int64)) << CELL_BITS


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams seen once to four times."""
    n = counts.agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(x or 0, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(float(min(max(d, 0.1), cap)) for d, cap in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.95),
                                                             (3 - 4 * y * n4 / n3, 2.95)))


def probabilities(wanted: DataFrame, tables: list[DataFrame], base: float) -> DataFrame:
    """``wanted`` n-grams (context, char) with their log probabilities ``logp``, from the counts of
    each order, lowest first. ``base``: the probability below the lowest."""
    out = wanted.withColumn("p", F.lit(base))
    for order, counts in enumerate(tables, 1):
        d1, d2, d3 = discounts(counts)
        c = F.col("c")
        cut = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        seen = counts.select(F.col("context").alias("_context"), F.col("char").alias("_char"), (c - cut).alias("_more"))
        contexts = counts.groupBy(F.col("context").alias("_of")).agg(F.sum("c").alias("_total"), F.sum(cut).alias("_cuts"))
        short = F.col("context").bitwiseAND((1 << BITS * (order - 1)) - 1)
        out = out.withColumn("_short", short).join(checked_broadcast(seen), (F.col("_short") == F.col("_context")) & (F.col("char") == F.col("_char")), "left")
        out = out.join(checked_broadcast(contexts), F.col("_short") == F.col("_of"), "left")
        p = F.when(F.col("_total").isNull(), F.col("p")).otherwise(
            (F.coalesce("_more", F.lit(0.0)) + F.col("_cuts") * F.col("p")) / F.col("_total"))
        out = out.select("context", "char", p.alias("p"))
    return out.select("context", "char", F.log(F.greatest("p", F.lit(1e-12))).cast("float").alias("logp"))


def shares(before: np.ndarray, point: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The shares of the characters without a symbol of their own in their class, from the
    counts of all pairs of a symbol and such a character after it, each array ending in a place for what was never seen: code points
    and their log shares, pairs and their log shares after the symbol before; and symbols and the log weight that they
    give to pairs never seen. Characters never seen count as one."""
    def discount(c):
        n1, n2 = max((c == 1).sum(), 1), max((c == 2).sum(), 1)
        return n1 / (n1 + 2 * n2)
    points, at = np.unique(point, return_inverse=True)
    each = np.bincount(at, n, len(points))
    d = discount(each)
    share = np.append(each - d, d * len(points)) / each.sum() if len(points) else np.ones(1)
    symbols, of = np.unique(before, return_inverse=True)
    d = discount(n)
    sums, kinds = np.bincount(of, n, len(symbols)), np.bincount(of, minlength=len(symbols))
    weight = d * kinds / sums
    after = (n - d) / sums[of] + weight[of] * share[at]
    pair = before * POINTS + point
    order = np.argsort(pair)
    return (np.append(points, 2 ** 62), np.log(share).astype(np.float32), np.append(pair[order], 2 ** 62),
            np.log(np.append(after[order], 1)).astype(np.float32), np.append(symbols, 2 ** 62), np.log(np.append(weight, 1)))


def log_shares(before: np.ndarray, point: np.ndarray, known: tuple[np.ndarray, ...]) -> np.ndarray:
    """Log shares of characters after the symbols before them, by what :func:`shares` gave."""
    others, share, seen, after, symbols, weight = known

    def place(values, wanted):  # the last place for what is not there
        at = np.searchsorted(values, wanted)
        return np.where(values[at] == wanted, at, len(values) - 1)
    whole = place(seen, before * POINTS + point)
    alone = weight[place(symbols, before)] + share[place(others, point)]
    return np.where(whole < len(seen) - 1, after[whole], alone)


def train(trusted: DataFrame, symbols: int | None) -> tuple[np.ndarray | None, list[DataFrame], float, tuple[np.ndarray, ...]]:
    """(code points with a symbol of their own, None for all; counts of each order's n-grams, lowest first; the probability below them;
    shares of all other characters)."""
    known = None
    if symbols is not None:
        top = (trusted.mapInArrow(_points_task, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
               .orderBy(F.desc("n"), "point").limit(symbols - 2).collect())
        known = np.array(sorted(r.point for r in top), np.uint32)
    counted = trusted.mapInArrow(_grams_task(known), "context long, char long, c long").groupBy("context", "char").agg(F.sum("c").alias("c"))
    counted = write_stage(counted, "op10-counts")
    others = counted.filter("context < 0").toPandas().to_numpy(np.int64)  # none if all characters are symbols
    tables = [counted.filter("context >= 0")]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: different characters before an n-gram
        short = F.col("context").bitwiseAND((1 << BITS * (k - 1)) - 1)
        tables.insert(0, write_stage(tables[0].groupBy(short.alias("context"), "char").agg(F.count(F.lit(1)).alias("c")), "op10-continuations"))
    return known, tables, 1.0 / (symbols or tables[0].count() + 2), shares(-1 - others[:, 0], others[:, 1], others[:, 2])


def _score(symbols: np.ndarray | None, others: tuple[np.ndarray, ...]):
    """Perplexities of the texts of a chunk, from the log probabilities of its n-grams."""
    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        key = numbers(known["context"].to_numpy(), known["char"].to_numpy())
        order = np.argsort(key)
        key, logp = key[order], known["logp"].to_numpy()[order].astype(float)
        out = []
        for packed in texts["rows"]:
            rows = pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()
            points, first, context, char = _slice_grams(rows, symbols)
            log = logp[np.searchsorted(key, numbers(context, char))] if len(points) else np.zeros(0)
            rare = np.flatnonzero(char == OTHER)
            if len(rare):
                log[rare] += log_shares(context[rare] & POINTS - 1, points[rare].astype(np.int64), others)
            total = np.append(0.0, np.cumsum(log))
            n = np.diff(first)
            mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
            out.append(pa.table([rows["doc_id"], rows["lang"], pa.array(n.astype(np.int64)), pa.array(np.exp(-mean), mask=n == 0)],
                                names=["doc_id", "lang", "n_chars", "perplexity"]))
        return pa.concat_tables(out)
    return run


def quality_by_perplexity(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, symbols: int | None = SYMBOLS) -> DataFrame:
    """Rows, one per row of ``docs``: doc_id, lang, n_chars, perplexity,
    threshold, kept.

    ``symbols``: how many symbols the model knows (the most frequent characters, a border and the
    class of all others); None gives every character of the trusted text one of its own.
    A null or empty text has no perplexity and is kept, as are all documents if
    none is trusted. Documents without an id or a language are scored and held
    against the threshold of all trusted ones. Repeated rows are scored each. An
    empty table gives no rows. Of labels that differ for one document the lowest
    counts. Only doc_id, text and lang, and doc_id and quality, are read.
    """
    good = (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
            .filter("q = 1").select("doc_id"))
    src = docs.select("doc_id", "text", "lang")
    rows = with_rows(src, "op10-rows").toDF("doc_id", "text", "lang", "row")
    if spread_text(src) is not src:  # a scan that is too narrow; chunks go by the numbers of rows, not by their order
        rows = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    trusted = rows.select("doc_id", "text").join(checked_broadcast(good), "doc_id").select("text")
    points, tables, base, others = train(trusted, symbols)
    starts = chunk_starts(rows)
    seen = rows.select("text", "row").mapInArrow(_seen_task(starts, points), "chunk long, context long, char long")
    seen = write_stage(seen, "op10-seen", compression="zstd")
    logs = write_stage(probabilities(seen.select("context", "char").distinct(), tables, base), "op10-probabilities")
    texts = rows.mapInArrow(_texts_task(starts), "chunk long, rows binary")
    scored = texts.groupBy("chunk").cogroup(seen.join(logs, ["context", "char"]).groupBy("chunk")).applyInArrow(
        _score(points, others), "doc_id long, lang string, n_chars long, perplexity double")
    scored = write_stage(scored, "op10-scores")
    known = scored.join(checked_broadcast(good), "doc_id").filter("perplexity is not null")
    # interpolated, over logarithms of four decimals: as many values as these, whatever the input; too few rows have no such quantile
    cut = F.when(F.count(F.lit(1)) >= MIN_TRUSTED, F.exp(F.percentile(F.round(F.log("perplexity"), 4), quantile)))
    cut = cut.otherwise(F.max("perplexity"))
    overall = known.agg(cut.alias("t")).first()["t"]
    by_lang = known.filter("lang is not null").groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("n"), cut.alias("t"))
    by_lang = by_lang.filter(F.col("n") >= MIN_TRUSTED).select("l", "t")
    out = scored.join(checked_broadcast(by_lang), F.col("lang") == F.col("l"), "left")
    out = out.withColumn("threshold", F.coalesce("t", F.lit(overall).cast("double")))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold",
                      F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))


def q_op10(spark, sf_dir: str) -> DataFrame:
    return quality_by_perplexity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), symbols=None)
