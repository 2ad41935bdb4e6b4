"""Operator 3, quality rules: an isolation forest on rule statistics.

Each text is reduced to a few counts by vectorised rules. The forest is grown on
a bounded sample of the rows labelled good (of all documents, if none is). Its
random cuts are drawn from a little beyond the range of a node's rows, so
documents unlike the good ones fall into empty branches early: they are
isolated after few splits. The score is 2 ** (-mean path length / expected
path length). Every document is scored, and the rejection threshold comes from the scores of all labelled rows: the one
that tells labels apart best among those that reject at most
``max_false_rejects`` of the rows labelled good.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import hash_sample, spread_text, table, write_stage
from cairn.llm.kernels import Prefix, Words, per_row, repeated, salted, slices, text_buffer

TREES, TREE_ROWS, SAMPLE_ROWS = 96, 256, 16_384
WIDEN = 0.3
"""Cuts reach beyond a node's range by this share of it on either side."""
MAX_FALSE_REJECTS = 0.002
BINS = 2_000
REPEAT_WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct",
          "n_short_words", "n_distinct"]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def count_rules(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Rule counts of the texts of one slice."""
    rows = len(offs) - 1
    w = Words(data, offs, lower=False)

    def spans(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[end] - c[start]
    head = (data & 0xC0) != 0x80  # first bytes of characters
    chars = spans(head, w.start, w.end)
    # lines: cut at \n and at text borders
    brk = np.flatnonzero(data == 0x0A)
    doc_of = np.searchsorted(offs, brk, "right") - 1
    full = np.arange(rows)
    line_start = np.concatenate([offs[:-1], brk + 1])
    line_end = np.concatenate([np.zeros(rows, np.int64), np.zeros(len(brk), np.int64)])
    line_doc = np.concatenate([full, doc_of])
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    line_end = np.empty(len(line_start), np.int64)
    if len(line_start):
        line_end[:-1] = line_start[1:] - 1
        last = np.flatnonzero(np.diff(np.append(line_doc, -1)))
        line_end[last] = offs[1:][line_doc[last]]
    words_before = np.searchsorted(w.start, line_start)
    has_word = np.searchsorted(w.start, line_end) > words_before
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    _, later = repeated(salted(w.prefix.of(line_start, line_end), line_doc))
    # words in windows found twice or more
    covered = np.zeros(len(w.hash) + 1, np.int64)
    h, at = w.windows(REPEAT_WINDOW)
    long_ = w.count[w.doc[at]] >= REPEAT_WINDOW if len(at) else np.zeros(0, bool)
    h, at = h[long_], at[long_]
    twice, _ = repeated(salted(h, w.doc[at]))
    covered[at[twice]] = 1  # each window starts at a place of its own
    covered[REPEAT_WINDOW:] -= covered[:-REPEAT_WINDOW].copy() if len(covered) > REPEAT_WINDOW else 0
    inside = np.cumsum(covered)[:-1] > 0
    _, again = repeated(salted(w.hash, w.doc))
    upper = (data >= 65) & (data <= 90)
    begin, end = offs[:-1], offs[1:]
    return {"n_words": w.count, "word_chars": per_row(chars, w.doc, rows), "n_symbols": spans(SYMBOLS[data], begin, end),
            "n_dup_lines": per_row(later, line_doc, rows), "n_repeat_words": per_row(inside, w.doc, rows),
            "n_lines": np.bincount(line_doc, minlength=rows), "n_upper": spans(upper, begin, end),
            "n_punct": spans(PUNCT[data], begin, end), "n_short_words": per_row(chars <= 2, w.doc, rows),
            "n_distinct": per_row(~again, w.doc, rows)}


def _count_task(batches):
    for b in batches:
        data, offs = text_buffer(b.column("text"))
        for lo, hi in slices(offs):
            c = count_rules(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo),
                                              *[pa.array(c[k].astype(np.int64)) for k in COUNTS]], names=["doc_id", *COUNTS])


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics, one row per document, that do not grow with its length."""
    n = np.maximum(c["n_words"], 1).astype(float)
    lines, chars = np.maximum(c["n_lines"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([c["word_chars"] / n, np.log1p(50 * c["n_symbols"] / chars), c["n_dup_lines"] / lines,
                            c["n_repeat_words"] / n, c["n_upper"] / chars, c["n_punct"] / chars, c["n_short_words"] / n])


def expected_path(n: np.ndarray | int):
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_forest(x: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Complete binary trees as arrays: feature, cut and leaf path length."""
    rng = np.random.default_rng(seed)
    rows = min(TREE_ROWS, len(x))
    depth = max(1, math.ceil(math.log2(max(rows, 2))))
    size = 2 ** (depth + 1) - 1
    feature, cut = np.zeros((TREES, size), np.int32), np.full((TREES, size), np.inf)
    leaf = np.zeros((TREES, size))
    least = 0.05 * np.ptp(x, axis=0) + 1e-9

    def grow(t: int, node: int, part: np.ndarray, level: int) -> None:
        if level == depth or len(part) <= 1:
            leaf[t, node] = level + expected_path(len(part))
            return
        f = int(rng.integers(x.shape[1]))
        lo, hi = part[:, f].min(), part[:, f].max()
        reach = WIDEN * max(hi - lo, least[f])
        c = rng.uniform(lo - reach, hi + reach)
        feature[t, node], cut[t, node], leaf[t, node] = f, c, -1
        left = part[:, f] <= c
        for child, sub in ((2 * node + 1, part[left]), (2 * node + 2, part[~left])):
            if len(sub):
                grow(t, child, sub, level + 1)
            else:
                leaf[t, child] = level + 1
    for t in range(TREES):
        grow(t, 0, x[rng.choice(len(x), rows, replace=False)], 0)
    return {"feature": feature, "cut": cut, "leaf": leaf, "expected": np.array(max(float(expected_path(rows)), 1e-9))}


def anomaly(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores of rows in (0, 1): the higher, the sooner isolated."""
    total = np.zeros(len(x))
    for feature, cut, leaf in zip(forest["feature"], forest["cut"], forest["leaf"]):
        node = np.zeros(len(x), np.int64)
        while (inner := leaf[node] < 0).any():
            k = node[inner]
            node[inner] = 2 * k + np.where(x[inner, feature[k]] <= cut[k], 1, 2)
        total += leaf[node]
    return 2.0 ** (-(total / len(forest["leaf"])) / float(forest["expected"]))


def _score_task(forest):
    def run(batches):
        for b in batches:
            c = {k: b.column(k).to_numpy() for k in COUNTS}
            score = anomaly(forest, statistics(c)) if forest is not None else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])
    return run


def calibrate(good: np.ndarray, bad: np.ndarray, max_false: float) -> float:
    """Threshold over score bins: most bad rows rejected among the thresholds
    that reject at most ``max_false`` of the good ones; above 1 (none
    rejected) if there are no labels of a kind."""
    if not good.sum() or not bad.sum():
        return 2.0
    false = good[::-1].cumsum()[::-1] / good.sum()
    true = bad[::-1].cumsum()[::-1] / bad.sum()
    ok = np.flatnonzero((false <= max_false) & (true > 0))
    if not len(ok):
        return 2.0
    return float(ok[np.argmax(true[ok] - false[ok])]) / len(good)


def quality_rules(docs: DataFrame, labels: DataFrame, max_false_rejects: float = MAX_FALSE_REJECTS) -> DataFrame:
    """Rows: doc_id, the rule counts, score, threshold, base_failed, kept.

    A null or empty text has no words and fails the base rule. Repeated rows
    are scored each; a null doc_id is kept and never labelled. Without documents
    there are no rows; without labels of both kinds the base rule alone decides.
    Only doc_id and text, and doc_id and quality of the labels, are read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    counts = write_stage(spread_text(docs.select("doc_id", "text")).mapInArrow(_count_task, schema), "op3-counts")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = counts.filter(~failed)
    trusted = usable.join(marks.filter("quality = 1"), "doc_id", "left_semi")
    sample = hash_sample(trusted if trusted.limit(1).count() else usable, SAMPLE_ROWS, "doc_id", *COUNTS).toPandas()
    x = statistics({c: sample[c].to_numpy() for c in COUNTS})
    forest = grow_forest(x) if len(x) else None
    scored = write_stage(counts.mapInArrow(_score_task(forest), schema + ", score double"), "op3-scores")
    hist = (scored.filter(~failed).join(marks, "doc_id")
            .groupBy((F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1))).cast("int").alias("bin"), "quality")
            .agg(F.count(F.lit(1)).alias("n")).collect())
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in hist:
        (good if r.quality else bad)[r.bin] += r.n
    threshold = calibrate(good, bad, max_false_rejects)
    return scored.select("doc_id", *COUNTS, "score", F.lit(threshold).alias("threshold"), failed.alias("base_failed"),
                         (~failed & (F.col("score") < threshold)).alias("kept"))


def q_op3(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "score", "threshold")
