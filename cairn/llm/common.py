"""Helpers shared by the operators: staged tables, checked broadcasts and a
distributed row numbering. Everything written goes to the shared folder named
by ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.plans.guard import broadcast_if_small
from cairn.plans.partitioning import blocks_by_bytes
from cairn.plans.partitioning import spread as spread_text
from cairn.session import table, write_stage

__all__ = ["table", "write_stage", "checked_broadcast", "blocks_for", "number_rows", "with_rows", "spread_once", "spread_text", "hash_sample"]

BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow numeric rows) with a broadcast hint if a bounded count
    finds at most ``max_rows``; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


BLOCK_BYTES = 16 << 20


def blocks_for(docs: DataFrame) -> int:
    """Number of hash blocks that packed arrays from the texts of ``docs`` are
    dealt over: it grows with the files, so a block's size does not."""
    return blocks_by_bytes(docs, BLOCK_BYTES)


def spread_once(docs: DataFrame, stage: str) -> DataFrame:
    """``spread_text``; rows that it dealt anew are written, so that a task that
    runs again reads them in the same order."""
    dealt = spread_text(docs)
    return docs if dealt is docs else write_stage(dealt, stage)


def hash_sample(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has fewer), chosen by a hash of
    ``cols``: no sort, and the same rows in every run."""
    n = df.count()
    if n <= rows:
        return df
    share = int(1_000_000 * rows / n)
    return df.filter(F.pmod(F.xxhash64(*cols), F.lit(1_000_000)) < share)


def with_rows(docs: DataFrame, stage: str) -> DataFrame:
    """``docs``, a table as read, with its columns renamed ``c0``, ``c1``, ... and
    ``row``: a number of each row, alike in every job. It comes from the row's
    file and place in it, which do not depend on how files are split into tasks; files are
    numbered once, in a written table. A table not read from Parquet files is written with its numbers."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    try:
        place = docs.metadataColumn("_metadata")
        numbered = docs.select("*", place["file_path"], place["row_index"])
    except AnalysisException:
        return write_stage(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()), stage)
    placed = numbered.toDF(*inner, "file", "place")
    # a bucket of files lies in one task, so (bucket, place in the task) names a file; numbers stay below 2**27
    files = placed.select("file").distinct().withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(64)))
    files = files.repartition(64, "bucket").withColumn("id", F.monotonically_increasing_id())
    no = F.col("bucket") + 64 * F.col("id").bitwiseAND((1 << 33) - 1)
    files = write_stage(files.select("file", no.alias("no")), f"{stage}-files")
    joined = placed.join(broadcast_if_small(files), "file")
    return joined.select(*inner, (F.shiftleft("no", 36) + F.col("place")).alias("row"))


def number_rows(df: DataFrame, group: str, order: list, name: str, stage: str) -> DataFrame:
    """Adds ``name``: the row's place within ``group``, gapless from 0, by ``order``.

    A range sort on (group, order) splits any group over tasks; each row's
    place in its task comes from the task itself, and only one count per
    (group, task) is summed up. ``order`` holds column names.
    """
    spark = df.sparkSession
    parts = blocks_for(df)
    sorted_ = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    at = write_stage(sorted_.withColumn("_mid", F.monotonically_increasing_id()), stage)
    at = at.withColumn("_task", F.shiftright("_mid", 33)).withColumn("_idx", F.col("_mid").bitwiseAND((1 << 33) - 1))
    tasks = at.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = tasks.select(F.col(group).alias("_g"), F.col("_task").alias("_t"),
                         (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = at.join(checked_broadcast(tasks), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_task") == F.col("_t")))
    return joined.withColumn(name, F.col("_idx") + F.col("_shift")).drop("_mid", "_task", "_idx", "_g", "_t", "_shift")
