"""Replay a recorded table as a file stream, and run streams to completion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _as_number(c: Column, is_time: bool) -> Column:
    return F.unix_micros(c.cast("timestamp")) if is_time else c.cast("long")


ROWS_PER_CHUNK = 2_000_000  # rows per staged micro-batch file


def time_span(df: DataFrame, order_col: str) -> tuple[int, int, int]:
    """(first, last, rows) of an order column; times in microseconds."""
    key = _as_number(F.col(order_col), dict(df.dtypes)[order_col].startswith("timestamp"))
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    return (lo or 0), (hi or 0), n


def stage_chunks(df: DataFrame, root: str, order_col: str, chunks: int = 4, rows_per_chunk: int = ROWS_PER_CHUNK,
                 span: tuple[int, int, int] | None = None) -> str:
    """Write ``df`` as one file per ascending range of ``order_col``, in one
    parallel write, with modification times that follow the ranges, as a recorded
    stream would arrive. Returns the glob that :func:`file_stream` reads.

    The ranges divide ``span`` (default: that of ``df``) evenly, so several
    sources of one stream that share a span have their i-th files, and
    micro-batches, over the same range; an empty range gives an empty file. There
    are at least ``chunks`` of them, more when the input is large.
    """
    spark = df.sparkSession
    lo, hi, n = span or time_span(df, order_col)
    chunks = max(chunks, -(-n // rows_per_chunk))
    step = max(1, (hi - lo + chunks) // chunks)
    key = _as_number(F.col(order_col), dict(df.dtypes)[order_col].startswith("timestamp"))
    number = F.greatest(F.lit(0), F.least(F.floor((key - F.lit(lo)) / F.lit(step)), F.lit(chunks - 1))).cast("int")
    numbered = df.withColumn("_c", F.coalesce(number, F.lit(0)))
    numbered.repartitionById(chunks, F.col("_c")).write.mode("overwrite").partitionBy("_c").parquet(f"{root}/split")
    _arrive_in_order(spark, f"{root}/split", chunks, df)
    return f"{root}/split/_c=*/*.parquet"


def stage_tick(spark: SparkSession, root: str, after_us: int, chunks: int) -> str:
    """A clock for replays: empty files for all micro-batches of a recording and
    then one row ``ts`` at ``after_us``, which moves the watermark past its end."""
    ts = F.timestamp_micros(F.lit(after_us)).cast("timestamp_ntz")
    spark.range(1).select(ts.alias("ts"), F.lit(chunks).alias("_c")).write.mode("overwrite").partitionBy("_c").parquet(f"{root}/split")
    _arrive_in_order(spark, f"{root}/split", chunks + 1, spark.range(0).select(ts.alias("ts")))
    return f"{root}/split/_c=*/*.parquet"


def _arrive_in_order(spark: SparkSession, root: str, chunks: int, empty_like: DataFrame) -> None:
    """Give the files of chunk i the i-th second as their modification time;
    missing chunks get an empty file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    for i in range(chunks):
        folder = jvm.org.apache.hadoop.fs.Path(f"{root}/_c={i}")
        if not fs.exists(folder):
            empty_like.limit(0).coalesce(1).write.parquet(f"{root}/_c={i}")
        for f in fs.listStatus(folder):
            fs.setTimes(f.getPath(), (1_600_000_000 + i) * 1000, -1)


def file_stream(spark: SparkSession, root: str, glob: str = "", files_per_trigger: int = 1) -> DataFrame:
    """A file stream over staged chunks, one file per micro-batch."""
    schema = spark.read.parquet(f"{root}{glob}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root}{glob}")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Operators with lists, maps and timers in their state need this store, which holds it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append-mode stream -> parquet sink, run until the available input is done."""
    use_rocksdb(stream.sparkSession)
    q = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_foreach_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str,
                      mode: str = "append") -> None:
    """Stream -> ``fn(batch_df, batch_id)``, run until the available input is done.
    ``fn`` must be idempotent per batch id (a retried batch is replayed)."""
    use_rocksdb(stream.sparkSession)
    q = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
