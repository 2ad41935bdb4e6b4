"""Operator 4, toxicity: a linear-chain conditional random field.

1. Keys of a word are its whole and its first 3 to 6 bytes. Over a sample of
   the labelled training rows (at most ``SAMPLE_ROWS``), keys that occur in
   significantly more toxic than clean documents become features (at most
   ``MAX_FEATURES``, by the G-test).
2. Labelled tokens: a word of a toxic document with a feature is toxic, all
   other words are clean. A two-state chain over the words of a line (pieces of
   ``PIECE`` words) is trained on them by its exact likelihood gradient.
3. Forward-backward gives each word's marginal. A document's score is a
   logistic function, fitted on the same sample, of the largest and the summed
   marginals of its words with features, so that length alone is no evidence;
   runs of words with a marginal of one half or more are its spans. Pieces
   without any feature are not computed.

Labels and the text are the only inputs; rows whose
crc32(doc_id) is 2 modulo 4 are never learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import checked_broadcast, hash_sample, spread_text, table, write_stage
from cairn.llm.kernels import Words, mix, repeated, salted, slices, text_buffer

SAMPLE_ROWS = 40_000
MAX_FEATURES = 8192
MIN_TOXIC, MIN_G, PURITY = 4, 26.0, 20
"""A feature occurs in at least MIN_TOXIC toxic documents and PURITY times as
many toxic as clean ones, with a G-test value of MIN_G."""
PIECE = 64
TRAIN_PIECES = 10_000
THRESHOLD = 0.3
HELD_OUT = 2
KEY_BYTES = (3, 4, 5, 6)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def word_keys(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index into ``which``) of the keys of some words."""
    start, end = w.start[which], w.end[which]
    keys, owner = [w.hash[which]], [np.arange(len(which))]
    for k in KEY_BYTES:
        long_ = np.flatnonzero(end - start > k)
        keys.append(mix(w.prefix.of(start[long_], start[long_] + k) + np.uint64(k)))
        owner.append(long_)
    return np.concatenate(keys), np.concatenate(owner)


def word_heads(w: Words, data: np.ndarray) -> np.ndarray:
    """16-bit hash of each word's first three bytes (fewer, if it is shorter):
    the same for all words that share a key."""
    head = np.zeros(len(w.hash), np.uint32)
    for k in range(3):
        at = np.minimum(w.start + k, len(data) - 1)
        c = data[at].astype(np.uint32)
        c += np.uint32(32) * ((c >= 65) & (c <= 90)).astype(np.uint32)
        c[w.start + k >= w.end] = 0
        head = head * np.uint32(0x01000193) + c + np.uint32(1)
    return (head ^ (head >> np.uint32(15))) & np.uint32(0xFFFF)


def _stats_task(batches):
    """Per batch: every key with the number of toxic and clean rows that have it."""
    for b in batches:
        data, offs = text_buffer(b.column("text"))
        toxic = b.column("label").to_numpy()
        for lo, hi in slices(offs):
            w = Words(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
            keys, owner = word_keys(w, np.arange(len(w.hash)))
            doc = w.doc[owner] if len(owner) else owner
            _, later = repeated(salted(keys, doc))
            keys, y = keys[~later], toxic[lo:hi][doc[~later]]
            head = word_heads(w, data[offs[lo]:offs[hi]])[owner[~later]]
            uniq, example, inv = np.unique(keys, return_index=True, return_inverse=True)
            n = np.bincount(inv, minlength=len(uniq))
            t = np.bincount(inv, y, minlength=len(uniq)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(t), pa.array(n - t),
                                              pa.array(head[example].astype(np.int64))], names=["key", "toxic", "clean", "head"])


class Features:
    """The feature keys; words are looked up by their first three bytes first."""

    def __init__(self, keys: np.ndarray, heads: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.heads = np.zeros(1 << 16, bool)
        self.heads[heads] = True

    def of(self, w: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) pairs of a slice, sorted by word."""
        if not len(self.keys) or not len(w.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.flatnonzero(self.heads[word_heads(w, data)])
        keys, owner = word_keys(w, which)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        word, feature = which[owner[hit]], at[hit]
        order = np.lexsort((feature, word))
        return word[order], feature[order]


def pieces(w: Words, data: np.ndarray) -> np.ndarray:
    """Piece number of every word: lines, cut at every PIECE words."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    lines = np.append(0, np.cumsum(data == 0x0A))
    line = lines[w.start]
    new = np.append(True, (w.doc[1:] != w.doc[:-1]) | (line[1:] != line[:-1]))
    first = np.flatnonzero(new)
    place = np.arange(len(new)) - np.repeat(first, np.diff(np.append(first, len(new))))
    return np.cumsum(new | (place % PIECE == 0)) - 1


def marginals(emit: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Forward-backward over padded chains. ``emit``: (chains, steps) score of
    the toxic state over the clean one. Returns the marginals of the toxic state,
    the expected transitions (2 x 2, clean first) per chain and log partition."""
    n, steps = emit.shape
    e = np.zeros((n, steps, 2))
    e[:, :, 1] = emit
    alpha, beta = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
    alpha[:, 0] = start + e[:, 0]
    for t in range(1, steps):
        a = np.logaddexp(alpha[:, t - 1, :1] + trans[0], alpha[:, t - 1, 1:] + trans[1]) + e[:, t]
        alpha[:, t] = np.where((t < length)[:, None], a, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        nxt = beta[:, t + 1] + e[:, t + 1]
        b = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
        beta[:, t] = np.where((t + 1 < length)[:, None], b, 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    inside = np.arange(steps) < length[:, None]
    m = np.where(inside, np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0)), 0)
    pair = np.zeros((n, 2, 2))
    if steps > 1:
        nxt = beta[:, 1:] + e[:, 1:]
        for i in range(2):
            for j in range(2):
                p = alpha[:, :-1, i] + trans[i, j] + nxt[:, :, j] - z[:, None]
                pair[:, i, j] = np.where(inside[:, 1:], np.exp(np.minimum(p, 0)), 0).sum(1)
    return m, pair, z


class Model:
    """Weights: one per feature, a bias, start and transition scores."""

    def __init__(self, features: Features):
        self.features = features
        self.weight = np.zeros(len(features.keys))
        self.bias, self.start, self.trans = -4.0, np.array([0.0, -1.0]), np.array([[0.0, -1.0], [0.0, 0.0]])
        self.scale = np.array([-4.0, 4.0, 1.0])  # intercept, largest and summed marginals

    def fit(self, chains: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], rounds: int = 40) -> None:
        """``chains``: (words, word of each pair, feature of each pair, state of
        each word)."""
        if not chains:
            return
        n, steps = len(chains), max(c[0] for c in chains)
        length = np.array([c[0] for c in chains])
        row = np.concatenate([np.full(len(c[1]), i) for i, c in enumerate(chains)])
        at = np.concatenate([c[1] for c in chains])
        feature = np.concatenate([c[2] for c in chains])
        y = np.zeros((n, steps))
        for i, c in enumerate(chains):
            y[i, :c[0]] = c[3]
        inside = np.arange(steps) < length[:, None]
        both = inside[:, 1:]
        seen = np.array([[((1 - y[:, :-1]) * (1 - y[:, 1:]) * both).sum(), ((1 - y[:, :-1]) * y[:, 1:] * both).sum()],
                         [(y[:, :-1] * (1 - y[:, 1:]) * both).sum(), (y[:, :-1] * y[:, 1:] * both).sum()]])
        params = np.concatenate([self.weight, [self.bias], self.start, self.trans.ravel()])
        grad2 = np.full(len(params), 1e-8)
        k = len(self.weight)
        for _ in range(rounds):  # full gradient, AdaGrad steps
            self.weight, self.bias = params[:k], params[k]
            self.start, self.trans = params[k + 1:k + 3], params[k + 3:].reshape(2, 2)
            emit = np.bincount(row * steps + at, self.weight[feature], n * steps).reshape(n, steps) + self.bias
            m, pair, _ = marginals(emit, length, self.trans, self.start)
            diff = np.where(inside, y - m, 0)
            g = np.concatenate([np.bincount(feature, diff[row, at], k), [diff.sum()],
                                [-diff[:, 0].sum(), diff[:, 0].sum()], (seen - pair.sum(0)).ravel()]) / n
            g -= 1e-5 * params
            grad2 += g * g
            params = params + 0.5 * g / np.sqrt(grad2)

    def words(self, w: Words, data: np.ndarray):
        """(word, marginal, has a feature) of the words of pieces with features."""
        piece = pieces(w, data)
        first = np.searchsorted(piece, np.arange((int(piece[-1]) if len(piece) else -1) + 2))
        length = np.diff(first)
        word, feature = self.features.of(w, data)
        emit = np.bincount(word, self.weight[feature], len(piece))
        active = np.unique(piece[word])
        at, value = [np.zeros(0, np.int64)], [np.zeros(0)]
        for lo in range(0, len(active), 4096):
            some = active[lo:lo + 4096]
            steps = int(length[some].max())
            place = first[some][:, None] + np.arange(steps)
            inside = np.arange(steps) < length[some][:, None]
            m, _, _ = marginals(np.where(inside, emit[np.minimum(place, len(emit) - 1)], 0) + self.bias, length[some], self.trans,
                                self.start)
            at.append(place[inside])
            value.append(m[inside])
        at = np.concatenate(at)
        return at, np.concatenate(value), np.isin(at, word)

    def documents(self, w: Words, data: np.ndarray, rows: int):
        """(largest, summed) marginals per row, and its spans: (row, first byte,
        end byte, largest marginal)."""
        at, value, known = self.words(w, data)
        out = np.zeros((rows, 2))
        doc = w.doc[at[known]]
        np.maximum.at(out[:, 0], doc, value[known])
        out[:, 1] = np.bincount(doc, value[known], rows)
        at, value = at[value >= 0.5], value[value >= 0.5]
        new = np.append(True, (at[1:] != at[:-1] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]])) if len(at) else np.zeros(0, bool)
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(at)) - 1 if len(s) else s
        peak = np.maximum.reduceat(value, s) if len(s) else value
        return out, (w.doc[at[s]], w.start[at[s]], w.end[at[e]], peak)

    def score(self, stats: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(stats)), stats[:, 0], np.log1p(stats[:, 1])])
        return 1 / (1 + np.exp(-np.clip(x @ self.scale, -30, 30)))

    def calibrate(self, stats: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps, slopes held at zero or above."""
        x = np.column_stack([np.ones(len(stats)), stats[:, 0], np.log1p(stats[:, 1])])
        b = np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(3)
            b = b + np.clip(np.linalg.solve(h, x.T @ (y - p) - 1e-2 * b), -2, 2)
            b[1:] = np.maximum(b[1:], 0)
        self.scale = b


def _chains_task(features: Features, share: int):
    """Training pieces: those with features, and one in ``share`` of the others."""
    def run(batches):
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            label = b.column("label").to_numpy()
            for lo, hi in slices(offs):
                part = data[offs[lo]:offs[hi]]
                w = Words(part, offs[lo:hi + 1] - offs[lo])
                piece = pieces(w, part)
                word, feature = features.of(w, part)
                first = np.searchsorted(piece, np.arange(int(piece[-1]) + 2)) if len(piece) else np.zeros(1, np.int64)
                active = np.zeros(len(first) - 1, bool)
                active[piece[word]] = True
                key = mix(np.add.reduceat(w.hash, first[:-1])) if len(piece) else np.zeros(0, np.uint64)
                chosen = np.flatnonzero(active | (key % np.uint64(share) == 0))
                x, y = np.searchsorted(word, first[chosen]), np.searchsorted(word, first[chosen + 1])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo).take(pa.array(w.doc[first[chosen]] if len(chosen) else [], pa.int64())),
                     pa.array(key[chosen].view(np.int64)), pa.array((first[chosen + 1] - first[chosen])),
                     pa.array([word[i:j] - f for i, j, f in zip(x, y, first[chosen])], pa.list_(pa.int64())),
                     pa.array([feature[i:j] for i, j in zip(x, y)], pa.list_(pa.int64())),
                     pa.array(label[lo:hi][w.doc[first[chosen]]] if len(chosen) else [], pa.int64())],
                    names=["doc_id", "key", "words", "at", "feature", "label"])
    return run


SCORES = "score double, top double, total double, spans array<struct<from:long,to:long,marginal:double>>"


def _score_task(held, keep: list[str]):
    def run(batches):
        model = held.value
        span_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("marginal", pa.float64())]))
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            for lo, hi in slices(offs):
                part, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
                stats, (doc, start, end, peak) = model.documents(Words(part, o), part, hi - lo)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                spans = [[{"from": int(start[k] - o[i]), "to": int(end[k] - o[i]), "marginal": float(peak[k])}
                          for k in range(cut[i], cut[i + 1])] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(lo, hi - lo) for c in keep], pa.array(model.score(stats)), pa.array(stats[:, 0]),
                     pa.array(stats[:, 1]), pa.array(spans, span_type)], names=[*keep, "score", "top", "total", "spans"])
    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows that are not held out. Labels of one
    document that differ count as toxic; null ids and labels are left out.
    Without toxic and clean training rows the model calls nothing toxic."""
    marks = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("label"))
             .filter(remainder(F.col("doc_id")) != HELD_OUT))
    marks = hash_sample(marks, SAMPLE_ROWS, "doc_id")
    sample = spread_text(docs.select("doc_id", "text")).join(checked_broadcast(marks), "doc_id").select("doc_id", "text", "label")
    sample = write_stage(sample, "op4-sample")
    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    keys, heads = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n1 and n0:
        stats = sample.mapInArrow(_stats_task, "key long, toxic long, clean long, head long").groupBy("key").agg(
            F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.min("head").alias("head")).filter(f"t >= {MIN_TOXIC}")

        def part(seen, n, group):
            return F.when(seen > 0, seen * F.log(seen * (n0 + n1) / (n * group))).otherwise(0.0)
        t, c = F.col("t"), F.col("c")
        both = t + c
        g = 2 * (part(t, both, n1) + part(c, both, n0) + part(n1 - t, n0 + n1 - both, n1) + part(n0 - c, n0 + n1 - both, n0))
        chosen = stats.withColumn("g", g).filter((F.col("g") >= MIN_G) & (t >= PURITY * c)).orderBy(F.desc("g"), "key").limit(MAX_FEATURES)
        chosen = chosen.select("key", "head").collect()
        keys, heads = np.array([r.key for r in chosen], np.int64).view(np.uint64), np.array([r.head for r in chosen], np.int64)
    model = Model(Features(keys, heads))
    if not len(keys):
        model.scale = np.array([-6.0, 0.0, 0.0])
        return model
    lines = write_stage(sample.mapInArrow(_chains_task(model.features, 50), "doc_id long, key long, words long, at array<long>, "
                                          "feature array<long>, label long"), "op4-pieces")
    rows = sorted(hash_sample(lines, TRAIN_PIECES, "doc_id", "key").collect())
    chains = []
    for r in rows:
        state = np.zeros(r.words)
        if r.label and r.at:
            state[np.array(r.at)] = 1
        chains.append((r.words, np.array(r.at, np.int64), np.array(r.feature, np.int64), state))
    model.fit(chains)
    held = docs.sparkSession.sparkContext.broadcast(model)
    fitted = (sample.mapInArrow(_score_task(held, ["label"]), "label long, " + SCORES).select("label", "top", "total").toPandas())
    model.calibrate(fitted[["top", "total"]].to_numpy(), fitted["label"].to_numpy(float))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows, one per row of ``docs``: the columns ``keep``, score, top and total
    (largest and summed marginals), spans (byte ranges and their largest
    marginal).

    Null, empty and blank texts have no marginals and get the lowest score.
    Repeated rows are scored each. Empty tables give no rows. Only ``keep``, text
    and the labels' doc_id and toxic are read.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(train(docs, labels))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    src = spread_text(docs.select(*dict.fromkeys([*keep, "text"])))
    return src.mapInArrow(_score_task(held, list(keep)), schema + ", " + SCORES)


def q_op4(spark, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
