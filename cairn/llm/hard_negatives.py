"""Operator 12, hard-negative mining with anchor-clustered shared lists.

Anchors are clustered by angle. For a cluster with centre c and radius t (the largest angle
of a member to c), the score of member u and candidate x is at most
|u| |x| cos(max(0, angle(x, c) - t)). Candidates are dealt into groups of bounded
size; in each group and for each cluster they are sorted once by that bound
without |u|, and every member walks this shared list until its bound proves that
nothing further can enter its answer. Answers of the groups are merged by anchor.

Two walks: the first finds every anchor's best rows of its own label (positives), the second
the best rows of other labels within each positive's score band; there a member
also stops where the bound falls below the lowest score of its bands.
Scores are exact integers, bounds have a margin above rounding errors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import spread_text, table, write_stage
from cairn.llm.vector_codes import LARGEST, SCALE, finite, quantized

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
GROUP_ROWS = 1 << 16
"""Candidates that a task holds."""
CENTRES, ANCHORS_PER_CENTRE = 256, 64
"""Cluster centres are a sample of the anchors: one for so many anchors, at most CENTRES."""
MEMBERS, STEP = 256, 1024
"""Members that walk together, candidates that they score in one step."""
MARGIN = 1e-6


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled to length 1, lengths); zero rows stay zero."""
    norm = np.sqrt((m.astype(float) ** 2).sum(1))
    return m / np.where(norm > 0, norm, 1)[:, None], norm


def angles(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centre, -1, 1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2.0 ** 53:  # exact in doubles, which have the faster product
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Rows:
    """Rows of one vector length: matrix, label, vec_id (null: last), row number."""
    q: np.ndarray
    label: np.ndarray
    vec_id: np.ndarray
    null_id: np.ndarray
    row: np.ndarray

    def take(self, at) -> Rows:
        return Rows(self.q[at], self.label[at], self.vec_id[at], self.null_id[at], self.row[at])


class Group:
    """The candidates of a group with the shared list of one cluster at a time."""

    def __init__(self, rows: Rows):
        order = np.lexsort((rows.row, rows.vec_id, rows.null_id))
        self.rows = rows.take(order)  # place in the group: the order of ties
        self.units, self.norm = unit(self.rows.q)
        self.scored = 0

    def sort_for(self, centre: np.ndarray | None, radius: float) -> None:
        bound = self.norm
        if centre is not None:
            bound = self.norm * np.cos(np.maximum(0, angles(self.units, centre) - radius))
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order]
        self.listed = self.rows.take(self.order)

    def walk(self, members: Rows, who: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        """The best ``k`` candidates of every question: question i asks for the rows
        of the label of member ``who[i]`` (``same``) or of other labels that score
        low[i] to high[i]. Returns (question, place in the list, score)."""
        norm = unit(members.q)[1]
        size = norm * self.norm.max(initial=0)
        best = [np.zeros(0, np.int64)] * 3  # question, place, score
        kth = np.full(len(who), np.iinfo(np.int64).min)  # score and tie place of the last answer held, once there are k
        tie = np.full(len(who), np.iinfo(np.int64).max)
        alive = low <= high
        for lo in range(0, len(self.bound), STEP):
            reach = norm * self.bound[lo] + MARGIN * (size + 1)  # no later candidate scores more
            alive &= (reach[who] >= kth) & (reach[who] >= low)
            if not alive.any():
                break
            active = np.unique(who[alive])
            at = slice(lo, lo + STEP)
            score = products(members.q[active], self.listed.q[at])
            self.scored += score.size
            fits = self.listed.label[at][None] == members.label[active][:, None]
            fits = fits & (self.listed.row[at][None] != members.row[active][:, None]) if same else ~fits
            question = np.flatnonzero(alive)
            m = np.searchsorted(active, who[question])
            s = score[m]
            hit = fits[m] & (s >= np.maximum(low, kth)[question][:, None]) & (s <= high[question][:, None])
            hit &= (s > kth[question][:, None]) | (self.order[at][None] < tie[question][:, None])
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            new = [np.concatenate(x) for x in zip(best, (question[i], lo + j, s[i, j]))]
            order = np.lexsort((self.order[new[1]], -new[2], new[0]))
            new = [x[order] for x in new]
            start = np.flatnonzero(np.append(True, new[0][1:] != new[0][:-1]))
            rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            best = [x[rank < k] for x in new]
            full = new[0][rank == k - 1]
            kth[full], tie[full] = new[2][rank == k - 1], self.order[new[1]][rank == k - 1]
        return best


def _rows_of(b: pa.RecordBatch) -> dict[int, tuple[Rows, np.ndarray]]:
    """Rows of a batch by vector length, with their places in the batch."""
    q = b.column("q")
    lengths = np.diff(np.asarray(q.offsets))
    out = {}
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        part = b.take(pa.array(at)) if len(at) < b.num_rows else b
        ids = part.column("vec_id")
        out[d] = Rows(part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(len(at), d),
                      part.column("label").to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False),
                      ids.is_null().to_numpy(zero_copy_only=False), part.column("row").to_numpy(zero_copy_only=False)), at
    return out


def _join(parts: list[Rows]) -> Rows:
    return Rows(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("q", "label", "vec_id", "null_id", "row")])


def _assign_task(centres: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Adds each anchor's cluster (-1: no centre of its length) and its angle to the centre."""
    def run(batches):
        for b in batches:
            cluster, angle = np.full(b.num_rows, -1, np.int32), np.full(b.num_rows, np.pi)
            for d, (rows, at) in _rows_of(b).items():
                if d in centres:
                    numbers, units = centres[d]
                    u, norm = unit(rows.q)
                    near = (u @ units.T).argmax(1)
                    turn = np.arccos(np.clip((u * units[near]).sum(1), -1, 1))
                    cluster[at], angle[at] = numbers[near], np.where(norm > 0, turn, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster), pa.array(angle)],
                                             names=[*b.schema.names, "cluster", "angle"])
    return run


@dataclass
class Walker:
    """Task: the candidates of a group come first, then the anchors by cluster."""
    centres: dict[int, np.ndarray]
    radius: dict[int, float]
    same: bool
    k: int
    low: int = 0
    high: int = 0
    sorted: dict[int, int] = field(default_factory=dict)
    """The cluster that the group of a vector length is sorted for."""

    def __call__(self, batches):
        parts: dict[int, list[Rows]] = {}
        groups: dict[int, Group] | None = None
        for b in batches:
            kind = b.column("kind").to_numpy(zero_copy_only=False)
            for d, (rows, _) in _rows_of(b.filter(pa.array(kind == 0))).items():
                parts.setdefault(d, []).append(rows)
            members = b.filter(pa.array(kind == 1))
            if members.num_rows and groups is None:
                groups = {d: Group(_join(p)) for d, p in parts.items()}
                self.sorted.clear()
            cluster = members.column("cluster").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(cluster)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                for x in range(lo, hi, MEMBERS):
                    yield from self.answer(members.slice(x, min(MEMBERS, hi - x)), int(cluster[lo]), groups)

    def answer(self, b: pa.RecordBatch, cluster: int, groups: dict[int, Group]):
        for d, (members, at) in _rows_of(b).items():
            if d not in groups:
                continue
            g = groups[d]
            if self.sorted.get(d) != cluster:
                centre = self.centres.get(cluster)
                fits = centre is not None and len(centre) == d
                g.sort_for(centre if fits else None, self.radius.get(cluster, np.pi))
                self.sorted[d] = cluster
            if self.same:
                who = np.arange(len(at))
                low, high = np.full(len(at), np.iinfo(np.int64).min), np.full(len(at), np.iinfo(np.int64).max)
                extra = None
            else:
                pos = b.column("positives").take(pa.array(at))
                flat, who = pos.flatten(), np.repeat(np.arange(len(at)), np.diff(np.asarray(pos.offsets)))
                p = flat.field("score").to_numpy(zero_copy_only=False)
                low, high = -((-self.low * p) // 100), self.high * p // 100
                extra = flat
            i, place, score = g.walk(members, who, low, high, self.same, self.k)
            if not len(i):
                continue
            c = g.listed
            ids = pa.array(c.vec_id[place], mask=c.null_id[place])
            mine = pa.array(members.vec_id[who[i]], mask=members.null_id[who[i]])
            cols = {"anchor": pa.array(members.row[who[i]]), "anchor_id": mine, "row": pa.array(c.row[place]), "vec_id": ids,
                    "score": pa.array(score)}
            if extra is not None:
                taken = extra.take(pa.array(i))
                cols |= {"positive": taken.field("row"), "positive_id": taken.field("vec_id"), "positive_score": taken.field("score")}
            yield pa.RecordBatch.from_arrays([v.cast(pa.int64()) for v in cols.values()], names=list(cols))


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows by score, then vec_id, then row, with their ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                        low: int = LOW, high: int = HIGH) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for every anchor (rows of ``vectors`` where ``is_anchor``) and each
    of its ``positives`` best rows of its label, the ``negatives`` best rows of other
    labels with low * positive_score <= 100 * score <= high * positive_score.

    ``vectors``: vec_id, label (long) and q (array<int>, components under 2**20).
    Rows with a null label or q take no part. Repeated rows are rows of their own, ties go
    by vec_id, null ones last, then in the order read. Only rows of the anchor's
    vector length are scored. No anchors, or an empty table, give no rows.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("label IS NOT NULL AND q IS NOT NULL").withColumn("anchor", F.coalesce(is_anchor, F.lit(False)))
    rows = rows.select("vec_id", "label", "q", "anchor").withColumn("row", F.monotonically_increasing_id())
    rows = write_stage(rows, "op12-rows")  # row numbers are drawn once
    total, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    groups = max(spark.sparkContext.defaultParallelism, -(-total // GROUP_ROWS))
    anchors = rows.filter("anchor").drop("anchor")
    sample = anchors.orderBy(F.xxhash64("row")).limit(min(CENTRES, -(-n_anchors // ANCHORS_PER_CENTRE))).select("q").collect()
    centres = {i: unit(np.array([r.q], np.int64).reshape(1, -1))[0][0] for i, r in enumerate(sample)}
    by_length: dict[int, tuple] = {}
    for d in {len(c) for c in centres.values()}:
        numbers = np.array([i for i, c in centres.items() if len(c) == d], np.int32)
        by_length[d] = numbers, np.array([centres[i] for i in numbers]).reshape(len(numbers), d)
    schema = "vec_id long, label long, q array<int>, row long, cluster int, angle double"
    assigned = write_stage(anchors.mapInArrow(_assign_task(by_length), schema), "op12-anchors")
    radius = {r.cluster: r.radius for r in assigned.groupBy("cluster").agg(F.max("angle").alias("radius")).collect()}
    candidates = rows.select(F.lit(0).alias("kind"), F.lit(0).alias("cluster"), "vec_id", "label", "q", "row",
                             F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"))

    def walk(members: DataFrame, task: Walker, out: str) -> DataFrame:
        every = members.withColumns({"kind": F.lit(1), "group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
        both = candidates.unionByName(every, allowMissingColumns=True).repartitionById(groups, F.col("group"))
        return both.sortWithinPartitions("kind", "cluster").mapInArrow(task, out)
    found = "anchor long, anchor_id long, row long, vec_id long, score long"
    near = _first(walk(assigned.drop("angle"), Walker(centres, radius, True, positives), found), ["anchor"], positives)
    near = near.groupBy("anchor").agg(F.collect_list(F.struct("row", "vec_id", "score")).alias("positives"))
    asking = write_stage(assigned.drop("angle").join(near.withColumnRenamed("anchor", "row"), "row"), "op12-positives")
    found += ", positive long, positive_id long, positive_score long"
    hard = _first(walk(asking, Walker(centres, radius, False, negatives, low, high), found), ["anchor", "positive"], negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                       F.col("score").alias("negative_score"))


def q_op12(spark, sf_dir: str) -> DataFrame:
    e, i = F.col("embedding"), F.col("vec_id")
    rows = spread_text(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    small = ~F.exists(e, lambda x: F.abs(F.lit(float(SCALE)) * x.cast("double")) >= float(LARGEST))
    rows = rows.filter(F.col("label").isNotNull() & finite(e)).filter(small)
    label = F.when(i % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    vectors = rows.select("vec_id", label.alias("label"), quantized(e).cast("array<int>").alias("q"))
    return mine_hard_negatives(vectors, i % 100 == 0)


SQL_OP12 = """
WITH r AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row AS a, a.vec_id AS anchor_id, c.row AS c, c.vec_id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r c ON a.row <> c.row WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) AS n FROM s WHERE same) WHERE n <= 5),
h AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id, s.c) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 5
"""
