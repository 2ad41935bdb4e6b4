"""Whole text files, binary files, driver output logs; and the
executor-side writer that stages such files from a DataFrame."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

import cairn

# Fixed values of the reference tools.
DRIVER_OUTPUT_PREFIX = "driveroutput."
BLOB_GLOB = "*.{pdf,png,jpeg,jpg}"


def _filesystem(root: str):
    from pyarrow import fs as pafs
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root.removeprefix("file:")


def write_named_files(df: DataFrame, root: str, name_col: str, content_col: str) -> int:
    """Write one file per row, ``root/<name>`` = content (string or binary).

    Runs on the executors (``mapInPandas``) through pyarrow's filesystem
    layer, so ``root`` may be any shared filesystem URI. A retried task
    rewrites the same names with the same bytes. Returns the file count.
    """
    def write(batches):
        import pandas as pd
        filesystem, base = _filesystem(root)
        made = set()
        for pdf in batches:
            for name, content in zip(pdf[name_col], pdf[content_col]):
                path = f"{base.rstrip('/')}/{name}"
                parent = path.rsplit("/", 1)[0]
                if parent not in made:
                    filesystem.create_dir(parent, recursive=True)
                    made.add(parent)
                data = content.encode("utf-8") if isinstance(content, str) else bytes(content)
                with filesystem.open_output_stream(path) as out:
                    out.write(data)
            yield pd.DataFrame({"n": [len(pdf)]})

    written = df.select(name_col, content_col).mapInPandas(write, "n long")
    return int(written.agg(F.sum("n")).first()[0] or 0)


def write_text_parts(df: DataFrame, root: str, line_col: str, header: str | None = None,
                     suffix: str = ".txt") -> None:
    """Write ``line_col`` as text, one file per partition, each starting with
    ``header`` (a CSV reader with ``header=True`` skips one line per file).
    File names derive from the partition id, so a retry overwrites its own file."""
    def write(batches):
        import pandas as pd
        from pyspark import TaskContext
        filesystem, base = _filesystem(root)
        filesystem.create_dir(base, recursive=True)
        pid = TaskContext.get().partitionId()
        n = 0
        with filesystem.open_output_stream(f"{base.rstrip('/')}/part-{pid:05d}{suffix}") as out:
            if header is not None:
                out.write((header + "\n").encode("utf-8"))
            for pdf in batches:
                for line in pdf[line_col]:
                    out.write((line + "\n").encode("utf-8"))
                n += len(pdf)
        yield pd.DataFrame({"n": [n]})

    df.select(line_col).mapInPandas(write, "n long").agg(F.sum("n")).collect()


def whole_text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: ``(artifact_name, path, text, status)``; status 'ok'."""
    # text()'s own wholetext/glob parameters override reader options, so pass them here
    r = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return r.select(F.col("_metadata.file_name").alias("artifact_name"),
                               F.col("_metadata.file_path").alias("path"),
                               F.col("value").alias("text"), F.lit("ok").alias("status"))


def binary_files(spark: SparkSession, path: str, glob: str = BLOB_GLOB) -> DataFrame:
    """One row per PDF/PNG/JPEG file: ``(artifact_name, path, content, length, status)``."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", True).load(path))
    return df.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("artifact_name"), "path", "content",
                     "length", F.lit("ok").alias("status"))


def _canon(p: Column) -> Column:
    return F.regexp_replace(p, r"^file:/*", "/")


def _parent(p: Column) -> Column:
    return F.regexp_extract(_canon(p), r"^(.*)/[^/]*$", 1)


class DriverLogSource(DataSource):
    """The driver-output chunks below ``path``, folder by folder.

    Only the folders directly below ``path`` are listed when the scan is planned; what lies in
    them is listed and read by the tasks. One row per chunk; a folder without any gives one row of
    NULL name and text, a folder or chunk that cannot be read one with the ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return "driver_logs"

    def schema(self) -> str:
        return "dir string, file_name string, text string, error string"

    def reader(self, schema) -> DriverLogReader:
        return DriverLogReader(self.options["path"], int(self.options.get("folders_per_task", 64)))


class DriverLogReader(DataSourceReader):
    def __init__(self, root: str, folders_per_task: int):
        self.root, self.folders_per_task = root, folders_per_task

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs
        filesystem, base = _filesystem(self.root)
        found = filesystem.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        folders = sorted(f.path for f in found if f.type == pafs.FileType.Directory)
        n = self.folders_per_task
        return [InputPartition([base, *folders[i:i + n]] if i == 0 else folders[i:i + n]) for i in range(0, max(len(folders), 1), n)]

    def read(self, partition: InputPartition):
        filesystem, base = _filesystem(self.root)
        base = base.rstrip("/")
        for folder in partition.value:
            yield from self._folder(filesystem, folder.rstrip("/"), deeper=folder.rstrip("/") != base)

    def _folder(self, filesystem, folder: str, deeper: bool):
        """Rows of a folder and, below a job's folder, of the folders in it."""
        from pyarrow import fs as pafs
        try:
            inside = sorted(filesystem.get_file_info(pafs.FileSelector(folder)), key=lambda f: f.path)
        except OSError as e:
            yield folder, None, None, str(e)
            return
        chunks = [f for f in inside if f.type == pafs.FileType.File and f.base_name.startswith(DRIVER_OUTPUT_PREFIX)]
        for f in chunks:
            try:
                with filesystem.open_input_stream(f.path) as stream:
                    yield folder, f.base_name, stream.read().decode("utf-8", "replace"), None
            except OSError as e:
                yield folder, f.base_name, None, str(e)
        if not chunks:
            yield folder, None, None, None
        for f in inside if deeper else []:
            if f.type == pafs.FileType.Directory:
                yield from self._folder(filesystem, f.path, deeper)


def driver_logs(spark: SparkSession, root: str) -> DataFrame:
    """All folders and chunks below ``root`` (:class:`DriverLogSource`)."""
    cloudpickle.register_pickle_by_value(cairn)  # the scan is planned by a process that does not have the package
    try:
        spark.dataSource.register(DriverLogSource)
    finally:
        cloudpickle.unregister_pickle_by_value(cairn)
    return spark.read.format("driver_logs").load(root)


def driver_log_chunks(spark: SparkSession, root: str) -> DataFrame:
    """All driver-output chunk files under ``root``: ``(dir, file_name, text)``.
    The scalable form: one row per chunk, nothing concatenated."""
    return driver_logs(spark, root).where("text IS NOT NULL").select("dir", "file_name", "text")


def driver_log_text(spark: SparkSession, jobs: DataFrame, root: str) -> DataFrame:
    """``jobs(job_id, output_uri)`` -> ``(job_id, n_chunks, text)``.

    The chunks are the ``driveroutput.*`` objects directly in the URI's
    parent folder, concatenated in name order (zero-padded, so name order is
    chunk order). No URI, a folder that does not exist below ``root``, and one that cannot be
    read whole -> NULL; a folder without chunks -> ''. The concatenation is one value per job by
    definition; :func:`driver_log_chunks` keeps the rows.
    """
    per_dir = (driver_logs(spark, root).groupBy("dir")
               .agg(F.count("file_name").alias("n_chunks"), F.max("error").alias("error"),
                    F.expr("listagg(text, '') WITHIN GROUP (ORDER BY file_name)").alias("text")))
    per_dir = per_dir.where("error IS NULL").drop("error")
    out = jobs.withColumn("dir", _parent(F.col("output_uri"))).join(per_dir, on="dir", how="left")
    return out.select("job_id", "n_chunks", F.when(F.col("n_chunks").isNotNull(), F.coalesce("text", F.lit(""))).alias("text"))
