"""Operator 8, sharding: minimax contiguous partition of atomic groups.

Groups of equal texts are ordered by the MD5 digest of their text and cut into
contiguous shards so that the largest shard is as small as it can be. The
capacity is binary-searched: a capacity is feasible if the greedy filling of
shards in order needs no more than the given number.

The driver never sees the groups. It holds an ordered list of *segments*, runs
of groups with a common digest prefix, with their byte totals: 4,096 at first,
then only those that a cut can fall into are split by six more bits, one
aggregation per level, until every segment that matters is a single group.
Known boundaries bound each cut from both sides, so the result is the exact
optimum over single groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import number_rows, table, write_stage

SHARDS = 16
FIRST_BITS, STEP_BITS = 12, 6


@dataclass
class Segment:
    bits: int
    prefix: int
    size: int
    groups: int
    key: str


def greedy(sizes: list[int], capacity: int) -> list[int] | None:
    """Start index of every shard when each is filled up in order; None if
    one size is over the capacity."""
    starts, room = [], -1
    for i, s in enumerate(sizes):
        if s > capacity:
            return None
        if s > room:
            starts.append(i)
            room = capacity
        room -= s
    return starts


def smallest_capacity(sizes: list[int], shards: int, low: int) -> int:
    """Binary search for the smallest capacity of at least ``low`` for which
    the greedy filling needs at most ``shards``."""
    lo, hi = low, max(sum(sizes), low)
    while lo < hi:
        mid = (lo + hi) // 2
        starts = greedy(sizes, mid)
        if starts is not None and len(starts) <= shards:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _unsettled(segments: list[Segment], shards: int, low: int, high: int) -> list[int]:
    """Segments of several groups that some cut may fall into, for any
    capacity from ``low`` to ``high``."""
    ends, total = [], 0
    for s in segments:
        total += s.size
        ends.append(total)
    import bisect
    found: set[int] = set()
    lo_at, hi_at = 0, 0  # the j-th cut lies between these byte positions
    for _ in range(shards):
        hi_at += high
        i = bisect.bisect_right(ends, lo_at + low)
        lo_at = ends[i - 1] if i else 0
        for k in range(i, len(segments)):
            if ends[k] - segments[k].size >= hi_at:
                break
            if segments[k].groups > 1:
                found.add(k)
        if lo_at >= total:
            break
    return sorted(found)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """First key of every shard but the first, and the capacity. ``groups``
    has ``key`` (32 hex digits, unique) and ``size``."""
    def level(df: DataFrame, bits: int) -> list[Segment]:
        prefix = F.shiftright(F.conv(F.substring("key", 1, 15), 16, 10).cast("long"), 60 - bits)
        rows = (df.groupBy(prefix.alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"),
                                                  F.min("key").alias("k"), F.max("size").alias("m")).collect())
        nonlocal largest
        largest = max([largest, *(r.m for r in rows)])
        return [Segment(bits, r.p, r.s, r.n, r.k) for r in sorted(rows, key=lambda r: r.p)]

    largest, bits = 0, FIRST_BITS
    segments = level(groups, bits)
    while True:
        if not segments:
            return [], 0
        sizes = [s.size for s in segments]
        low = max(largest, -(-sum(sizes) // shards))
        high = smallest_capacity(sizes, shards, max(low, max(sizes)))
        todo = _unsettled(segments, shards, low, high) if bits + STEP_BITS <= 60 else []
        if not todo:
            break
        chosen = {segments[k].prefix for k in todo if segments[k].bits == bits}
        wanted = F.shiftright(F.conv(F.substring("key", 1, 15), 16, 10).cast("long"), 60 - bits).isin(sorted(chosen))
        bits += STEP_BITS
        finer: dict[int, list[Segment]] = {}
        for s in level(groups.filter(wanted), bits):
            finer.setdefault(s.prefix >> STEP_BITS, []).append(s)
        segments = [y for s in segments for y in
                    (finer[s.prefix] if s.bits == bits - STEP_BITS and s.prefix in chosen else [s])]
        # settled segments keep their coarser prefix; those still open are at the new depth
        for s in segments:
            if s.groups > 1 and s.bits < bits:
                s.prefix, s.bits = s.prefix << (bits - s.bits), bits
    capacity = smallest_capacity(sizes, shards, low)
    starts = greedy(sizes, capacity) or []
    return [segments[i].key for i in starts[1:]], capacity


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows: doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity.

    size is the text's UTF-8 bytes plus 1 (null text: as an empty one). Equal
    texts share a shard; repeated rows stay as many rows; a null doc_id is
    kept. An empty table gives no rows. Only doc_id and text are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = write_stage(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
                                   F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key")),
                       "op8-base")
    groups = write_stage(base.groupBy("key").agg(F.sum("size").alias("size")), "op8-groups")
    cuts, capacity = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") >= c).cast("int")
    placed = number_rows(base.withColumn("shard", shard), "shard", ["key", "doc_id"], "slot", "op8-slots")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))


def q_op8(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
