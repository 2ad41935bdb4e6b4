"""Operator 13, vector code compression with equal-average search.

Vectors of integers are cut into equal consecutive parts; every part position
has a codebook, and a part is stored as the number of its nearest entry. The nearest
entry is found by equal-average search: entries are sorted by the sum of their
components, the search starts where the part's own sum would stand and goes
outward, the smaller gap first. As d * |x - y|^2 >= (sum x - sum y)^2 for
d components, nothing further out can win, nor tie, once the squared gap over d strictly
exceeds the best distance found.

Codebooks are trained by rounds of assignment and averaging: a task adds up the
parts of its own rows (one row per part position and used entry leaves it), Spark
adds up the tasks. Only codebooks travel back, whose size is fixed
by ``parts`` and ``entries``, whatever the input. Sums and distances are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import checked_broadcast, spread_text, table, write_stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST, LONGEST_PART = 1 << 20, 1024
"""Bounds of a scaled component and of the components of a part: below them all sums are exact in 64 bits."""
ROWS_AT_ONCE = 8192


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, taken as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


class Codebook:
    """The entries of one part position, sorted by component sum for the search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # (number of entries, d)
        sums = entries.sum(1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]
        self.sorted = entries[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry numbers, squared distances, distances computed) of the rows
        of ``x``; of equally near entries the one with the lowest number."""
        n, d = x.shape
        k = len(self.sums)
        best = np.full(n, np.iinfo(np.int64).max, np.int64)
        code = np.full(n, k, np.int64)
        own = x.sum(1)
        up = np.searchsorted(self.sums, own)
        down = up - 1
        rows, computed = np.arange(n), 0
        far = np.iinfo(np.int64).max
        while len(rows):
            s, u, v = own[rows], up[rows], down[rows]
            gap_up = np.where(u < k, self.sums[np.minimum(u, k - 1)] - s, far)
            gap_down = np.where(v >= 0, s - self.sums[np.maximum(v, 0)], far)
            gap = np.minimum(gap_up, gap_down)
            go = gap < far
            # the squared gap over d exceeds the best distance: nothing further out is as near
            known = best[rows] < far
            go[known & go] = gap[known & go] ** 2 <= d * best[rows[known & go]]
            rows, upward = rows[go], (gap_up <= gap_down)[go]
            if not len(rows):
                break
            at = np.where(upward, up[rows], down[rows])
            up[rows] += upward
            down[rows] -= ~upward
            dist = ((x[rows] - self.sorted[at]) ** 2).sum(1)
            computed += len(rows)
            number = self.order[at]
            better = (dist < best[rows]) | ((dist == best[rows]) & (number < code[rows]))
            best[rows[better]], code[rows[better]] = dist[better], number[better]
        return code, best, computed


def _matrices(batches, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors of ``dim`` integers, as a matrix."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
            b = whole.slice(lo, ROWS_AT_ONCE)
            flat = b.column("q").flatten().to_numpy(zero_copy_only=False)
            yield b, flat.reshape(b.num_rows, dim)


def _sums_task(books: np.ndarray):
    """Component sums and counts of the parts assigned to each entry."""
    parts, entries, d = books.shape

    def run(batches):
        codebooks = [Codebook(b) for b in books]
        total = np.zeros((parts, entries, d), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for _, m in _matrices(batches, parts * d):
            for p, book in enumerate(codebooks):
                x = m[:, p * d:(p + 1) * d]
                code, _, _ = book.nearest(x)
                count[p] += np.bincount(code, minlength=entries)
                np.add.at(total[p], code, x)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
                                          pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])
    return run


def _codes_task(books: np.ndarray):
    parts, _, d = books.shape

    def run(batches):
        codebooks = [Codebook(b) for b in books]
        digits = np.array([f"{i:02x}" for i in range(max(256, books.shape[1]))])
        for b, m in _matrices(batches, parts * d):
            codes, error = [], np.zeros(b.num_rows, np.int64)
            for p, book in enumerate(codebooks):
                code, dist, _ = book.nearest(m[:, p * d:(p + 1) * d])
                codes.append(digits[code])
                error += dist
            text = ["".join(x) for x in zip(*codes)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array(error)],
                                             names=["vec_id", "label", "code", "error"])
    return run


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors with the smallest vec_ids (equal ones: smallest vector first), as
    (part, entry, component); None if no row has a vector that can be cut."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    if not rows:
        return None
    dim = len(rows[0].q)
    m = np.array([r.q for r in rows if len(r.q) == dim], np.int64)
    return m.reshape(len(m), parts, dim // parts).transpose(1, 0, 2)


def train_round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry becomes the floored mean of the
    parts nearest to it; an entry without any stays."""
    d = books.shape[2]
    sums = vectors.select("q").mapInArrow(_sums_task(books), "part int, entry int, n long, total array<long>")
    adds = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(d)]
    rows = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *adds).collect()  # parts * entries rows at most
    out = books.copy()
    for r in rows:
        out[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(d)]
    return out


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                     scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(rows, codebooks). Rows, one per row of ``embeddings`` with a vector of
    finite components: vec_id, label, code (entry numbers in part order, two hex digits
    each), error (squared distances summed over parts). Codebooks: integers by
    (part, entry, component), None without rows.

    Rows with a null vector, or a null or non-finite component, are dropped. Repeated rows are rows of
    their own; vec_id and label may be null. All vectors have the length of the
    one with the smallest vec_id, which ``parts`` must divide; code and error are null
    in a row of another length, of more than 1024 components a part, or with a component of
    2**20 or more after scaling. An empty table gives no rows. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry number must fit two hex digits")
    e = F.col("embedding")
    large = F.exists(e, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) >= float(LARGEST))
    rows = embeddings.select("vec_id", "label", "embedding").filter(finite(e))
    usable = ~large & (F.size(e) % parts == 0) & (F.size(e) > 0) & (F.size(e) <= parts * LONGEST_PART)
    q = F.when(usable, quantized(e, scale)).alias("q")
    cut = rows.select("vec_id", "label", q)
    books = first_codebooks(cut.filter("q is not null"), parts, entries)
    dim = books.shape[0] * books.shape[2] if books is not None else -1
    fits = F.coalesce(F.size("q") == dim, F.lit(False)) & F.col("q").isNotNull()
    none = cut.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books is None:
        return none, None
    vectors = spread_text(cut).filter(fits)
    for _ in range(rounds):
        books = train_round(vectors, books)
    kinds = dict(rows.dtypes)
    coded = vectors.mapInArrow(_codes_task(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    return coded.unionByName(none), books


def q_op13(spark, sf_dir: str) -> DataFrame:
    rows, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = codebook_digest(books) if books is not None else codebook_digest(np.zeros(0, np.int64))
    rows = write_stage(rows, "op13-codes")
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = rows.join(checked_broadcast(by_label), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql_op13(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The query in DuckDB SQL: every part against every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (
  SELECT p.row, p.part, arg_min(b.entry, d.dist * {entries} + b.entry) AS entry, min(d.dist) AS dist
  FROM p JOIN b{r} b ON p.part = b.part,
  LATERAL (SELECT list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist) d
  GROUP BY p.row, p.part)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT part, entry, list(c ORDER BY i) AS x
  FROM (SELECT a.part, a.entry, u.i, floor(sum(p.x[u.i])::DOUBLE / count(*))::BIGINT AS c
        FROM a{r} a JOIN p ON a.row = p.row AND a.part = p.part,
        LATERAL (SELECT unnest(range(1, len(p.x) + 1)) AS i) u GROUP BY a.part, a.entry, u.i)
  GROUP BY part, entry),
b{r + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
WITH q AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
         list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS (
  SELECT row, u.part, q[u.part * len(q) // {parts} + 1:(u.part + 1) * len(q) // {parts}] AS x
  FROM q, LATERAL (SELECT unnest(range(0, {parts})) AS part) u),
b0 AS (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {entries}),{",".join(steps)},
c AS (
  SELECT q.vec_id, q.label, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code, sum(a.dist)::BIGINT AS error
  FROM a{rounds} a JOIN q ON a.row = q.row GROUP BY q.row, q.vec_id, q.label),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS digest FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM c, s
"""


SQL_OP13 = sql_op13()
