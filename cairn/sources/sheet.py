"""Sheet exports (CSV with multi-line cells) read by many tasks per file.

Whether a line break ends a record depends on the quotes before it in the whole
file: it does if their number is even (a doubled quote inside a cell counts
twice). Lines are read by the splittable text source. A first scan adds up the quotes and
the records that begin in every block of a file, for both states a block can be entered in; prefix sums over the
blocks give the state and the number of records before each. A second one puts the lines of a block together
in the order they are read. Only records that lie in several blocks leave their task, and no text is written in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import write_stage

LINES_PER_GROUP = 8_192
BLANK = pa.array(["", "\r", "\r\r"])
"""Lines that are a record without a cell, once their line ends are dropped."""


def _groups(batches, size: int) -> Iterator[tuple[pa.RecordBatch, tuple[str, int]]]:
    """Lines of one block, at most ``size`` at a time, and the block."""
    for b in batches:
        file, block = b.column("file").dictionary_encode(), b.column("block").to_numpy()
        at = file.indices.to_numpy()
        cuts = np.flatnonzero((at[1:] != at[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(block)]):
            for i in range(lo, hi, size):
                yield b.slice(i, min(size, hi - i)), (file.dictionary[int(at[i])].as_py(), int(block[i]))


def _quotes(lines: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Quotes in each line, and whether it is blank."""
    value = lines.column("value")
    return pc.count_substring(value, '"').to_numpy().astype(np.int64), pc.is_in(value, BLANK.cast(value.type)).to_numpy(zero_copy_only=False)


def _sums_task(size: int):
    """Per block the quotes and the records that begin in it, if it is entered outside and inside quotes."""
    def row(key, sums):
        return pa.RecordBatch.from_pylist([dict(zip(("file", "block", "quotes", "outside", "inside"), (*key, *sums)))],
                                          pa.schema([("file", pa.string()), *((n, pa.int64()) for n in ("block", "quotes", "outside", "inside"))]))

    def run(batches):
        key, sums = None, [0, 0, 0]
        for lines, of in _groups(batches, size):
            if of != key:
                if key:
                    yield row(key, sums)
                key, sums = of, [0, 0, 0]
            quotes, blank = _quotes(lines)
            state = (sums[0] + np.cumsum(quotes) - quotes) % 2
            sums = [sums[0] + int(quotes.sum()), sums[1] + int((~blank & (state == 0)).sum()), sums[2] + int((~blank & (state == 1)).sum())]
        if key:
            yield row(key, sums)
    return run


def _records_task(size: int, header_rows: int, torn: bool):
    """The records that lie in one block or, if ``torn``, the pieces of the others: their number in the file and their text."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("record", pa.int64()), ("value", pa.string())])

    def rows(key, numbers, values):
        keep = numbers >= header_rows
        n = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key[0]), n), pa.repeat(pa.scalar(key[1], pa.int64()), n), pa.array(numbers[keep]),
                                           values.filter(pa.array(keep)).cast(pa.string())], schema=schema)

    def joined(value, ends):
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), value), "\n")

    def run(batches):
        key, quotes, number = None, 0, 0    # a block, the quotes and the records of its file so far
        parts, carried = [], False          # the record that no line has ended yet, and whether an earlier block began it

        def open_record():
            if parts and torn == (carried or quotes % 2 == 1):
                yield rows(key, np.array([number - 1]), pa.array(["\n".join(parts)]))
        for lines, of in _groups(batches, size):
            if of != key:
                yield from open_record()
                key, quotes, number = of, lines.column("entered")[0].as_py(), lines.column("before")[0].as_py()
                parts, carried = [], quotes % 2 == 1
            n, blank = _quotes(lines)
            value = lines.column("value")
            starts = np.flatnonzero((quotes + np.cumsum(n) - n) % 2 == 0)
            if not len(starts) or starts[0]:
                parts.append(joined(value, [0, starts[0] if len(starts) else len(value)])[0].as_py())
            if not len(starts):
                quotes += int(n.sum())
                continue
            quotes += int(n[:starts[0]].sum())
            yield from open_record()
            quotes += int(n[starts[0]:].sum())
            filled = ~blank[starts]
            numbers = number + np.cumsum(filled) - 1
            number += int(filled.sum())
            ended = len(starts) - quotes % 2
            if ended and not torn:
                ends = np.append(starts, len(value))[:ended + 1]
                yield rows(key, numbers[:ended][filled[:ended]], joined(value, ends).filter(pa.array(filled[:ended])))
            parts, carried = value.slice(starts[-1]).to_pylist() if ended < len(starts) else [], False
        yield from open_record()
    return run


def sheet_records(spark: SparkSession, path: str, header_rows: int = 1) -> DataFrame:
    """The records of the sheet's files as text, ``(file, value)``, without
    blank ones and without the first ``header_rows`` records of every file.

    Records end with a line feed, or carriage return and line feed, outside quotes; quotes
    stand around whole cells, and quotes in a cell are doubled, as exports write
    them. A line break in a cell is a line feed, whichever of the two the file has.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    sums = write_stage(lines.mapInArrow(_sums_task(LINES_PER_GROUP), "file string, block long, quotes long, outside long, inside long"), "sheet-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("entered", F.coalesce(F.sum("quotes").over(before), F.lit(0).cast("long")))
    begun = F.when(F.col("entered") % 2 == 0, F.col("outside")).otherwise(F.col("inside"))
    blocks = sums.select("file", "block", "entered", F.coalesce(F.sum(begun).over(before), F.lit(0).cast("long")).alias("before"))
    # a row per block, as in the list of blocks that the scan is planned from; lines stay in the order they are read
    state = lines.join(F.broadcast(write_stage(blocks, "sheet-entered")), ["file", "block"])

    def pieces(torn: bool) -> DataFrame:
        return state.mapInArrow(_records_task(LINES_PER_GROUP, header_rows, torn), "file string, block long, record long, value string")
    torn = pieces(True).groupBy("file", "record").agg(F.expr("listagg(value, '\n') WITHIN GROUP (ORDER BY block)").alias("value"))
    records = pieces(False).select("file", "value").unionByName(torn.select("file", "value"))
    return records.withColumn("value", F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), "\r$", ""))


def read_sheet(spark: SparkSession, path: str, schema: T.StructType, header_rows: int = 1) -> DataFrame:
    """The sheet as a table of ``schema``: surplus cells are ignored, missing ones NULL."""
    cells = F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                       {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    return sheet_records(spark, path, header_rows).select(cells.alias("c")).select("c.*")
