"""A table of the latest row per key that a stream keeps up to date without any
state of its own.

A micro-batch adds a part with the latest of its own rows; every ``merge_every``
batches the parts are merged into a base. What counts is the order of the rows, not
of the batches, so late rows and batches that are run again change nothing. The table
outlives the stream, and what it costs grows with the keys, not with the time that a session is silent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import written_folders


class LatestTable:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str], values: list[str], merge_every: int = 16):
        self.spark, self.root, self.merge_every = spark, root.rstrip("/"), merge_every
        self.keys, self.order, self.values = keys, order, values

    def latest(self, rows: DataFrame) -> DataFrame:
        """The last row of every key in ``order``."""
        last = F.max(F.struct(*self.order, *self.values)).alias("_last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "_last.*")

    def folders(self) -> list[str]:
        """The base in force and the parts after it."""
        found = [(int(n), kind) for kind, _, n in (f.partition("-") for f in written_folders(self.spark, self.root))]
        base = max((n for n, kind in found if kind == "base"), default=-1)
        return [f"{self.root}/{kind}-{n}" for n, kind in sorted(found) if (kind == "base" and n == base) or (kind == "part" and n > base)]

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Sink of a stream (``foreachBatch``)."""
        self.latest(batch).write.mode("overwrite").parquet(f"{self.root}/part-{batch_id}")
        base = f"{self.root}/base-{batch_id}"
        if (batch_id + 1) % self.merge_every == 0 and base not in self.folders():
            self.read().write.mode("overwrite").parquet(base)

    def read(self) -> DataFrame:
        """One row per key: keys, order and value columns. Needs one batch at least."""
        return self.latest(self.spark.read.parquet(*self.folders()))
