"""Input parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame


FILES_LOOKED_AT = 1000


def _file_sizes(df: DataFrame, files: list[str]) -> list[int]:
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    sizes = []
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        sizes.append(path.getFileSystem(conf).getFileStatus(path).getLen())
    return sizes


def scan_bytes(df: DataFrame) -> int | None:
    """Bytes of the files below ``df`` (no job, no plan of ``df``); None without
    files. Of more than FILES_LOOKED_AT files, as many at even distances stand for all."""
    files = sorted(df.inputFiles())
    if not files:
        return None
    looked = files[::-(-len(files) // FILES_LOOKED_AT)]
    return sum(_file_sizes(df, looked)) * len(files) // len(looked)


def blocks_by_bytes(df: DataFrame, block_bytes: int) -> int:
    """Number of blocks, runs or buckets that ``df`` is dealt over: one for every
    ``block_bytes`` of its files, at least one per core, so a block's size does not
    grow with the input. Without files, the number of shuffle partitions."""
    spark = df.sparkSession
    size = scan_bytes(df)
    if size is None:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(spark.sparkContext.defaultParallelism, -(-size // block_bytes))


def _scan_splits(df: DataFrame) -> int | None:
    """Tasks that the file scan below ``df`` gets, from its files' sizes alone
    (no job, no plan of ``df``); None without files."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return None
    if len(files) >= spark.sparkContext.defaultParallelism:
        return len(files)
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return sum(max(1, -(-s // split)) for s in _file_sizes(df, files))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df``, a projected file scan, over the cluster only when the
    scan is too narrow.

    A small file is read by one task, so a heavy per-row step (splitting and
    exploding text) would run serially. When the scan's files yield at least
    ``min_partitions`` (default: the cluster's default parallelism) tasks, as any
    large input does, ``df`` is returned unchanged and no shuffle is added.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    splits = _scan_splits(df)
    return df if splits is None or splits >= target else df.repartition(target)


def evaluate_once(df: DataFrame, keep: list[str], exprs: dict) -> DataFrame:
    """``keep`` columns plus ``exprs`` (name -> Column), where the new columns
    are produced by a one-row generator.

    Catalyst pushes a filter on a derived column below its projection by
    substituting the expression; a filter on several derived columns that
    share an expensive input (a JSON parse) then evaluates that input many
    times per row. A filter cannot be pushed below the generator that
    produces the columns it references, so expensive derived columns are
    computed exactly once per row, however callers filter them.
    """
    from pyspark.sql import functions as F
    row = F.struct(*[c.alias(n) for n, c in exprs.items()])
    return df.select(*keep, F.inline(F.array(row)))
