"""Ordered per-key scans that split a hot key across tasks.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to
one task; if one session holds a third of the data, one task does a third of
the work. Here the rows are range-sorted on (keys, order) once and written, and
each range (the *run* of one task) is scanned on its own:

1. rows are range-partitioned by (keys, order), so a key, a burst within a key
   or a long quiet session is split by rows, whatever its times are;
2. the scan runs per ``(keys, run)``, in parallel;
3. one summary row per ``(keys, run)`` is aggregated, and a small window over
   the summaries carries state across runs;
4. the carries join back on ``(keys, run)``, null-safe.

The result equals a single window's; NULL keys form a key of their own and NULL
order values sort first, as in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.partitioning import blocks_by_bytes
from cairn.session import write_stage

RUN = "_run"
RUN_BYTES = 64 << 20
"""Input files' bytes per run: runs grow in number with the input, not in size."""


def sorted_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` written once, range-sorted by (keys, order), with the number of
    the range of every row in ``_run`` (ascending with the order)."""
    n = partitions or blocks_by_bytes(df, RUN_BYTES)
    cols = [*keys, *order]
    d = df.repartitionByRange(max(n, 1), *cols).sortWithinPartitions(*cols)
    return write_stage(d.withColumn(RUN, F.spark_partition_id()), "ordered-scan")


def null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of column lists in which NULL equals NULL."""
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                 sums: Sequence[tuple[str, Column]] = (),
                 lasts: Sequence[tuple[str, Column]] = (),
                 prevs: Sequence[tuple[str, Column]] = (),
                 nexts: Sequence[tuple[str, Column]] = (),
                 partitions: int | None = None) -> DataFrame:
    """Add scan columns to ``df``, per ``keys`` in ascending ``order``.

    ``sums``  (out, numeric)  inclusive running sum
    ``lasts`` (out, value)    last non-NULL value at or before the row
    ``prevs`` (out, value)    value of the previous row; ``value`` must be non-NULL
                              on every row (wrap it in a struct)
    ``nexts`` (out, value)    value of the next row; same rule

    ``df`` is evaluated and written once, with all its columns: pass only those
    that are used. A ``df`` that already has the column ``_run`` comes from
    :func:`sorted_runs` and is not sorted again. Column arguments must refer to
    columns by name.
    """
    keys, order = list(keys), list(order)
    d = df if RUN in df.columns else sorted_runs(df, keys, order, partitions)
    w = Window.partitionBy(*keys, RUN).orderBy(*order)
    w_run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {}
    for out, v in sums:
        local[out] = F.sum(v).over(w_run)
    for out, v in lasts:
        local[out] = F.last(v, ignorenulls=True).over(w_run)
    for out, v in prevs:
        local[out] = F.lag(v).over(w)
    for out, v in nexts:
        local[out] = F.lead(v).over(w)

    # summaries from the written table itself (not from the window output)
    pos = F.struct(*order)
    summary_aggs = ([F.sum(v).alias(f"_s_{o}") for o, v in sums]
                    + [F.max_by(v, F.when(v.isNotNull(), pos)).alias(f"_s_{o}") for o, v in lasts]
                    + [F.max_by(v, pos).alias(f"_s_{o}") for o, v in prevs]
                    + [F.min_by(v, pos).alias(f"_s_{o}") for o, v in nexts])
    summary = d.groupBy(*keys, RUN).agg(*summary_aggs)
    d = d.withColumns({f"_l_{k}": c for k, c in local.items()})
    wb = Window.partitionBy(*keys).orderBy(RUN)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    carry = {}
    for o, _ in sums:
        carry[o] = F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0))
    for o, _ in lasts:
        carry[o] = F.last(f"_s_{o}", ignorenulls=True).over(before)
    for o, _ in prevs:
        carry[o] = F.lag(f"_s_{o}").over(wb)
    for o, _ in nexts:
        carry[o] = F.lead(f"_s_{o}").over(wb)
    right = [f"_k{i}" for i in range(len(keys) + 1)]
    carries = summary.select(*[F.col(k).alias(r) for k, r in zip([*keys, RUN], right)],
                             *[c.alias(f"_c_{o}") for o, c in carry.items()])

    joined = d.join(carries, null_safe([*keys, RUN], right), "inner")
    final = {}
    for o, _ in sums:
        final[o] = F.col(f"_l_{o}") + F.col(f"_c_{o}")
    for o, _ in [*lasts, *prevs, *nexts]:
        final[o] = F.coalesce(F.col(f"_l_{o}"), F.col(f"_c_{o}"))
    out = joined.withColumns(final)
    return out.drop(RUN, *right, *[f"_l_{o}" for o in final], *[f"_c_{o}" for o in final])
