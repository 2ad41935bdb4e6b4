"""Rows of a session in order: a base for stateful stream operators.

A row is held until the watermark has passed it and then handed over in
order, so a row that comes late within the watermark's delay takes its place.
Keys are dealt to ``BUCKETS`` groups, whatever their number, and the state is kept per
group: a micro-batch wakes a group once, not each of its keys, so what it costs grows with
its rows and not with the number of sessions that have some.
Held rows lie in the state store as pieces of one micro-batch each. Of
them only an index (piece, first time) is read again; a piece is read when its first
row is due, and what is not due yet replaces it. Timers, not micro-batches, wake
a group: one for its earliest held row, and those that an operator sets itself.
What an operator remembers of a key beyond the held rows is kept for as long as the result needs it,
however long the session is silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

import cairn

BUCKETS = 512
PIECE_ROWS = 10_000
ABSENT = "absent_"
"""Prefix of the null flags. Names that begin with an underscore do not reach a processor."""
TICK = "tick"


def event_time(df: DataFrame, delay: str, col: str = "ts") -> DataFrame:
    """``_et``: the event time as TIMESTAMP (watermarks reject TIMESTAMP_NTZ),
    with a watermark of ``delay``."""
    return df.withColumn("_et", F.col(col).cast("timestamp")).withWatermark("_et", delay)


def micros(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Times as microseconds."""
    return col.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)


class OrderedProcessor(StatefulProcessor):
    """Hands the rows of a group of keys to :meth:`fold`, sorted by ``key`` and within it by ``order``, of which
    the first column is the event time.

    ``schema``: Arrow schema of the rows. Subclasses return result rows from :meth:`fold`, called with the rows
    that are due (none, if a timer of their own woke the group), what they remember
    of the group's keys, and the watermark in microseconds.
    """

    columns: list[str] = []  # of the result
    memory: list[tuple[str, pa.DataType]] = []  # what is remembered of a key

    def __init__(self, schema: pa.Schema, key: str, order: list[str]):
        self.schema, self.key, self.order = schema, key, order

    def init(self, handle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("held", "piece long", "rows binary")
        self.index = handle.getValueState("index", "upto long, pieces array<long>, firsts array<long>")
        self.known = handle.getValueState("known", "keys binary")
        self.prepare(handle)

    def prepare(self, handle) -> None:
        """Declares further state of the operator's own."""

    def accepts(self, rows: pa.RecordBatch) -> np.ndarray | None:
        """Which new rows are of any use; None: all."""
        return None

    def begin(self) -> None:
        """Called when the group, which held no rows, gets some."""

    def fold(self, rows: pa.Table, known: dict, watermark: int) -> list[tuple] | pa.Table:
        """``known``: from keys to tuples of ``memory``; what is changed in it is remembered."""
        raise NotImplementedError

    def wake(self, at_micros: int) -> None:
        """A timer that fires once the watermark is beyond ``at_micros``."""
        self.handle.registerTimer(at_micros // 1000 + 1)

    def recall(self) -> dict:
        if not self.known.exists():
            return {}
        columns = pa.ipc.open_stream(self.known.get()[0]).read_all().columns
        keys, *values = [c.to_pylist() for c in columns]
        return dict(zip(keys, zip(*values))) if values else dict.fromkeys(keys, ())

    def _remember(self, known: dict) -> None:
        if not known:
            self.known.clear()
            return
        fields = [pa.field("key", pa.int64()), *[pa.field(*m) for m in self.memory]]
        values = zip(*known.values()) if self.memory else []
        table = pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip([list(known), *map(list, values)], fields)], schema=pa.schema(fields))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.known.update((sink.getvalue().to_pybytes(),))

    def _batch(self, frame: pd.DataFrame) -> pa.RecordBatch:
        cols = []
        for f in self.schema:
            missing = frame[ABSENT + f.name].to_numpy() if pa.types.is_integer(f.type) else None
            cols.append(pa.Array.from_pandas(frame[f.name], mask=missing, type=f.type))
        return pa.RecordBatch.from_arrays(cols, schema=self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        upto, pieces, firsts = self.index.get() if self.index.exists() else (0, [], [])
        pieces, firsts = list(pieces), list(firsts)
        held, before = len(pieces), min(firsts, default=None)
        for frame in rows:
            for lo in range(0, len(frame), PIECE_ROWS):
                batch = self._batch(frame.iloc[lo:lo + PIECE_ROWS])
                useful = self.accepts(batch)
                if useful is not None:
                    batch = batch.filter(pa.array(useful))
                if not len(batch):
                    continue
                self.pieces.updateValue((upto,), (batch.serialize().to_pybytes(),))
                pieces.append(upto)
                firsts.append(int(micros(batch.column(self.order[0])).min()))
                upto += 1
        if len(pieces) > held:
            self.index.update((upto, pieces, firsts))
            if before is None:
                self.begin()
            if before is None or min(firsts) < before:
                self.wake(min(firsts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        known = self.recall()
        before = dict(known)
        out = self.fold(self._due(watermark), known, watermark)
        if known != before:
            self._remember(known)
        if isinstance(out, pa.Table):
            if len(out):
                yield out.to_pandas(integer_object_nulls=True)  # integers stay integers beside nulls
        elif out:
            yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def _due(self, watermark: int) -> pa.Table:
        """Takes the rows at or before the watermark out of the state."""
        upto, pieces, firsts = self.index.get() if self.index.exists() else (0, [], [])
        due, left = [], []
        for piece, first in zip(pieces, firsts):
            if first > watermark:
                left.append((piece, first))
                continue
            batch = pa.ipc.read_record_batch(pa.py_buffer(self.pieces.getValue((piece,))[0]), self.schema)
            ts = micros(batch.column(self.order[0]))
            later = ts > watermark
            if later.any():
                rest = batch.filter(pa.array(later))
                self.pieces.updateValue((piece,), (rest.serialize().to_pybytes(),))
                left.append((piece, int(ts[later].min())))
                batch = batch.filter(pa.array(~later))
            else:
                self.pieces.removeKey((piece,))
            due.append(batch)
        if due and left:
            self.index.update((upto, [p for p, _ in left], [f for _, f in left]))
            self.wake(min(f for _, f in left))
        elif due:
            self.index.clear()
        rows = pa.Table.from_batches(due, self.schema)
        return rows.sort_by([(c, "ascending") for c in [self.key, *self.order]]).combine_chunks() if len(rows) else rows

    def runs(self, rows: pa.Table) -> Iterator[tuple[int | None, int, int]]:
        """(key, first row, row after the last) of every key of sorted rows."""
        keys = rows.column(self.key)
        if not len(rows):
            return
        ids, null = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy()
        starts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            yield None if null[lo] else int(ids[lo]), lo, hi


def ordered_stream(rows: DataFrame, key: str, order: list[str], make, out: str, delay: str | None) -> DataFrame:
    """``rows`` folded per ``key`` (an integer; null ones form a key of their own) by the :class:`OrderedProcessor` that ``make``
    builds from their schema, in append mode. ``delay`` None: ``rows`` carry a
    watermark already, on their column ``_et``."""
    schema = to_arrow_schema(rows.drop("_et").schema)
    timed = rows if delay is None else event_time(rows, delay, order[0])
    # pandas has no null integers: one among the rows would turn all of them into floating-point numbers
    numbers = [f.name for f in schema if pa.types.is_integer(f.type)]
    flags = {ABSENT + c: F.col(c).isNull() for c in numbers}
    timed = timed.withColumns({"bucket": F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"), **flags})
    timed = timed.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(dict(rows.dtypes)[c])) for c in numbers})
    # Spark also starts a Python process beside its driver to set the state up. That one does not get the files
    # sent to executors, so the classes go to it whole and not by the name of their module.
    cloudpickle.register_pickle_by_value(cairn)
    try:
        return timed.groupBy("bucket").transformWithStateInPandas(make(schema, key, order), out, "append", "EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(cairn)
