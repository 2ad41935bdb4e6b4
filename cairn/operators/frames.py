"""Frame signatures and near-duplicate suppression (F3-F5, T2 helper, T3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.media import (
    hamming_distance_bits,
    mean_threshold_bits,
    mean_threshold_signature,
)
from cairn.plans.guard import broadcast_if_small
from cairn.plans.ordered import RUN, RUN_BYTES, null_safe, ordered_scan, sorted_runs
from cairn.plans.partitioning import blocks_by_bytes
from cairn.session import write_stage

# Fixed value of the reference client: frames within Hamming distance 1 of
# the last frame sent are not sent.
DUPLICATE_DISTANCE = 1


def with_signatures(frames: DataFrame, values: str = "grey") -> DataFrame:
    """Add ``signature`` (64-character bit string) and ``sig_bits`` (packed long)."""
    v = F.col(values)
    return frames.withColumns({"signature": mean_threshold_signature(v), "sig_bits": mean_threshold_bits(v)})


def consecutive_distances(frames: DataFrame, stream: str = "stream", order: str = "frame_id") -> DataFrame:
    """Hamming distance of every frame to the previous frame of its stream."""
    prev = ordered_scan(frames.select(stream, order, "sig_bits"), [stream], [order],
                        prevs=[("_prev", F.struct(F.col(order).alias("id"), F.col("sig_bits").alias("b")))])
    return prev.select(stream, order, F.col("_prev.id").alias("prev_frame_id"),
                       hamming_distance_bits(F.col("sig_bits"), F.col("_prev.b")).alias("distance"))


def suppress_near_duplicates(frames: DataFrame, threshold: int = DUPLICATE_DISTANCE,
                             stream: str = "stream", order: str = "frame_id",
                             partitions: int | None = None) -> DataFrame:
    """Keep a frame iff its distance to the *last kept* frame of its stream
    exceeds ``threshold``; the first frame of a stream is kept.

    The fold is sequential by definition, but its only state is the last kept
    signature. Frames are range-sorted by (stream, order) and written once; each
    run of rows folds on its own (:func:`fold_in_runs`), so a stream holding a
    third of all frames, or a burst in it, spreads over its runs. ``frames``
    needs ``sig_bits`` (see :func:`with_signatures`). Frames of a NULL stream
    are a stream of their own.
    """
    rows = sorted_runs(frames.select(stream, order, "sig_bits"), [stream], [order], partitions)
    kept = fold_in_runs(rows, int(threshold), stream, order)
    kept = kept.select(F.col(stream).alias("_ks"), F.col(order).alias("_ko"))
    return frames.join(kept, null_safe([stream, order], ["_ks", "_ko"]), "left_semi")


def sample_frames(frames: DataFrame, window: str = "1 second") -> DataFrame:
    """The latest frame per tumbling window and stream: stream, ts, frame_id, signature, sig_bits."""
    latest = F.max(F.struct("ts", "frame_id", "signature", "sig_bits")).alias("_f")
    return frames.groupBy("stream", F.window("ts", window)).agg(latest).select("stream", "_f.*")


def sampled_frames(frames: DataFrame, window: str = "1 second", threshold: int = DUPLICATE_DISTANCE) -> DataFrame:
    """What a client sends: of the sampled frames (:func:`sample_frames`) those that
    differ from the last one sent. The samples are read more than once: written."""
    return suppress_near_duplicates(write_stage(sample_frames(frames, window), "sampled-frames"), threshold)


# --- exact fold by runs -----------------------------------------------------------

_IN, _HAS_IN = "_in", "_has_in"  # the state a segment was entered with (bits, present?)
_KEEP, _STATE = "_keep", "_state"


def fold_bits(bits: np.ndarray, last: np.uint64 | None, threshold: int) -> np.ndarray:
    """Positions of the kept frames of a segment entered with ``last``. From one
    kept frame to the next, the distances of a whole block are taken at once."""
    kept, at, step = [], 0, 64
    if last is None and len(bits):
        kept, last, at = [0], bits[0], 1
    while at < len(bits):
        far = np.flatnonzero(np.bitwise_count(bits[at:at + step] ^ last) > threshold)
        if len(far):
            at += int(far[0])
            kept.append(at)
            last, at, step = bits[at], at + 1, 64
        else:
            at, step = at + step, min(step * 2, 1 << 16)
    return np.array(kept, np.int64)


def _fold(rows: DataFrame, stream: str, order: str, threshold: int) -> DataFrame:
    """Fold every segment ``(stream, _run)`` of ``rows`` from its entering state."""
    schema = rows.select(stream, order, "sig_bits", RUN, _IN, _HAS_IN, F.lit(False).alias(_KEEP),
                         F.lit(0).cast("long").alias(_STATE)).schema
    n = blocks_by_bytes(rows, RUN_BYTES)
    rows = rows.repartition(n, stream, RUN).sortWithinPartitions(RUN, stream, order)

    def fold(batches):
        state, key = None, None
        for pdf in batches:
            s, r = pdf[stream].to_numpy(), pdf[RUN].to_numpy()
            null = pdf[stream].isna().to_numpy()
            bits = pdf["sig_bits"].to_numpy(dtype=np.int64).view(np.uint64)
            new = np.ones(len(pdf), bool)
            new[1:] = ~((s[1:] == s[:-1]) | (null[1:] & null[:-1])) | (r[1:] != r[:-1])
            bounds = np.append(np.flatnonzero(new), len(pdf))
            keep, out = np.zeros(len(pdf), bool), np.zeros(len(pdf), np.uint64)
            for a, b in zip(bounds[:-1], bounds[1:]):
                mine = (None if null[a] else s[a], r[a])
                if mine != key:
                    key = mine
                    state = np.uint64(int(pdf[_IN].iloc[a]) & 0xFFFFFFFFFFFFFFFF) if pdf[_HAS_IN].iloc[a] else None
                at = fold_bits(bits[a:b], state, threshold)
                keep[a + at] = True
                if len(at):
                    sizes = np.diff(np.append(at, b - a))
                    out[a + at[0]:b] = np.repeat(bits[a + at], sizes)
                    out[a:a + at[0]] = state if state is not None else 0
                    state = bits[a + at[-1]]
                else:
                    out[a:b] = state
            pdf = pdf[[stream, order, "sig_bits", RUN, _IN, _HAS_IN]]
            pdf[_KEEP], pdf[_STATE] = keep, out.view(np.int64)
            yield pdf

    return rows.mapInPandas(fold, schema)


def refold_bits(bits: np.ndarray, old: np.ndarray, last: np.uint64, threshold: int) -> tuple[list[int], int | None, np.uint64]:
    """A segment folded again, entered with ``last``: (positions kept, position from
    which the fold ``old`` is right again, last kept frame). Two folds that keep the same
    frame agree from there on, so the second is not gone through further."""
    kept, at, step = [], 0, 64
    while at < len(bits):
        far = np.flatnonzero(np.bitwise_count(bits[at:at + step] ^ last) > threshold)
        if not len(far):
            at, step = at + step, min(step * 2, 1 << 16)
            continue
        at += int(far[0])
        if old[at]:
            return kept, at, last
        kept.append(at)
        last, at, step = bits[at], at + 1, 64
    return kept, None, last


def _refold(rows: DataFrame, stream: str, order: str, threshold: int) -> DataFrame:
    """Runs folded again from the state ``_IN``: the rows whose answer changes, with
    ``_KEEP``, and for every run that stays different to its end a row without ``order``, with
    its final ``_STATE``."""
    schema = rows.select(stream, order, RUN, _KEEP, F.lit(None).cast("long").alias(_STATE)).schema
    n = blocks_by_bytes(rows, RUN_BYTES)
    rows = rows.repartition(n, stream, RUN).sortWithinPartitions(RUN, stream, order)

    def answer(frames: pd.DataFrame, keep, state: np.uint64 | None) -> pd.DataFrame:
        out = frames.astype(object)
        out[_KEEP], out[_STATE] = pd.Series(keep, out.index, object), None
        if state is not None:
            out[order], out[_STATE] = None, int(np.array([state]).view(np.int64)[0])
        return out

    def fold(batches):
        key, head, last, done = None, None, None, False
        for pdf in batches:
            s, r, null = pdf[stream].to_numpy(), pdf[RUN].to_numpy(), pdf[stream].isna().to_numpy()
            names = pdf[[stream, order, RUN]]
            bits, old = pdf["sig_bits"].to_numpy(dtype=np.int64).view(np.uint64), pdf[_KEEP].to_numpy(dtype=bool)
            new = np.ones(len(pdf), bool)
            new[1:] = ~((s[1:] == s[:-1]) | (null[1:] & null[:-1])) | (r[1:] != r[:-1])
            bounds = np.append(np.flatnonzero(new), len(pdf))
            for a, b in zip(bounds[:-1], bounds[1:]):
                mine = (None if null[a] else s[a], r[a])
                if mine != key:
                    if key is not None and not done:
                        yield answer(head, [None], last)
                    key, head, done = mine, names.iloc[a:a + 1], False
                    last = np.uint64(int(pdf[_IN].iloc[a]) & 0xFFFFFFFFFFFFFFFF)
                if done:
                    continue
                kept, again, last = refold_bits(bits[a:b], old[a:b], last, threshold)
                done = again is not None
                keep = np.zeros(b - a, bool)
                keep[kept] = True
                changed = np.flatnonzero((keep != old[a:b])[:again])
                if len(changed):
                    yield answer(names.iloc[a + changed], keep[changed].tolist(), None)
        if key is not None and not done:
            yield answer(head, [None], last)

    return rows.mapInPandas(fold, schema)


def fold_in_runs(rows: DataFrame, threshold: int, stream: str = "stream", order: str = "frame_id",
                 rewritten: list[int] | None = None) -> DataFrame:
    """``(stream, order)`` of the frames kept by the last-kept fold (exact).

    First every run of a stream is folded as if nothing had been kept before
    it. A run's answer depends on its entering state only, the final state of the
    run before; a scan over one row per run finds the runs that were entered with
    another state. Only those are folded again, and only up to the first frame that the
    old and the new fold both keep; what is written is the rows whose answer changes. A
    run that agrees before its end leaves the next one alone. That takes at most one
    round per run of a stream, and few in practice. ``rewritten`` gets the number of rows written per round.
    """
    first = rows.withColumns({_IN: F.lit(0).cast("long"), _HAS_IN: F.lit(False)})
    base = write_stage(_fold(first, stream, order, threshold).select(stream, order, "sig_bits", RUN, _KEEP, _STATE), "fold")
    runs = base.groupBy(stream, RUN).agg(F.max_by(_STATE, F.struct(order)).alias("_out"))
    runs = write_stage(runs.withColumn(_IN, F.lit(None).cast("long")), "fold-runs")
    changes = None
    same = null_safe([stream, RUN], ["_s", "_r"])
    for number in range(1 << 30):
        w = Window.partitionBy(stream).orderBy(RUN)
        need = runs.withColumn("_need", F.lag("_out").over(w)).where("NOT _need <=> " + _IN)
        need = write_stage(need.select(F.col(stream).alias("_s"), F.col(RUN).alias("_r"), "_need"), "fold-need")
        if not need.limit(1).count():
            break
        redo = _current(base.join(broadcast_if_small(need), same), changes, stream, order)
        redo = redo.select(stream, order, "sig_bits", RUN, _KEEP, F.col("_need").alias(_IN))
        found = write_stage(_refold(redo, stream, order, threshold), "fold-changes")
        if rewritten is not None:
            rewritten.append(found.count())
        ends = found.where(f"{_STATE} IS NOT NULL").select(F.col(stream).alias("_es"), F.col(RUN).alias("_er"), F.col(_STATE).alias("_end"))
        news = need.join(ends, null_safe(["_s", "_r"], ["_es", "_er"]), "left").select("_s", "_r", "_need", "_end")
        runs = runs.join(broadcast_if_small(news), same, "left").select(
            stream, RUN, F.coalesce("_end", "_out").alias("_out"), F.coalesce("_need", _IN).alias(_IN))
        runs = write_stage(runs, "fold-runs")
        rows_ = found.where(f"{_STATE} IS NULL").select(F.col(stream).alias("_cs"), F.col(order).alias("_co"), F.col(_KEEP).alias("_new"),
                                                        F.lit(number).alias("_round"))
        changes = rows_ if changes is None else changes.unionByName(rows_)
    return _current(base, changes, stream, order).where(F.col(_KEEP)).select(stream, order)


def _current(rows: DataFrame, changes: DataFrame | None, stream: str, order: str) -> DataFrame:
    """``rows`` with the last change of every answer."""
    if changes is None:
        return rows
    latest = changes.groupBy("_cs", "_co").agg(F.max_by("_new", "_round").alias("_new"))
    out = rows.join(broadcast_if_small(latest), null_safe([stream, order], ["_cs", "_co"]), "left")
    return out.withColumn(_KEEP, F.coalesce("_new", _KEEP)).drop("_cs", "_co", "_new")
