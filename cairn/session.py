"""Spark session defaults and the shared staging folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Submit-time properties of the reference job, used as defaults only.
DEFAULT_CONF = {
    "spark.sql.files.maxPartitionBytes": "100m",
    "spark.dynamicAllocation.executorAllocationRatio": "0.5",
    "spark.executor.memoryOverheadFactor": "0.4",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of unreferenced DataFrames are removed during the run
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # session state of many sessions lives off-heap, checkpointed incrementally
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "cairn",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create or reuse a session. ``DEFAULT_CONF`` only fills settings the
    cluster (spark-submit, spark-defaults) has not set; ``shuffle_partitions``
    and ``extra`` are the caller's explicit choices and always apply."""
    from pyspark import SparkConf, SparkContext

    SparkContext._ensure_initialized()  # the JVM-backed conf sees submit-time settings
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    present = SparkConf()
    conf = {k: v for k, v in DEFAULT_CONF.items() if not present.contains(k)}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: functions
    that run in tasks are pickled by reference to their module."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # a driver that itself runs from an archive got it from the cluster
        archive = os.path.join(tempfile.mkdtemp(prefix="cairn-package-"), "cairn.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, str(f.relative_to(package.parent)))
        spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is only read; without it
    nothing runs there. In local mode (tests) a fresh folder is created and set
    once.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = _LOCAL_FALLBACK.get(spark.sparkContext.applicationId)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="cairn-ckpt-")
        _LOCAL_FALLBACK[spark.sparkContext.applicationId] = d
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - some deployments refuse runtime changes of core confs
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_LOCAL_FALLBACK: dict[str, str] = {}


def write_stage(df, name: str, **options):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    return the table read back: the lineage is cut, a lost executor costs a
    re-read instead of a recomputation, and every later use scans the
    table instead of recomputing ``df``. ``options`` go to the writer."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def written_folders(spark: SparkSession, root: str, inside: str = "") -> list[str]:
    """Names of the folders in ``root`` whose table (in their folder ``inside``) was written to the end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    mark = f"{inside}/_SUCCESS" if inside else "_SUCCESS"
    return [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/{mark}"))]


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a staged table or folder that nothing reads any more, before the driver exits."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_STAGE_ROOTS: dict[str, SparkSession] = {}


def staging_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint folder. All folders of
    an application lie together and are removed when its driver exits."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cairn-stage/{spark.sparkContext.applicationId}"
    if root not in _STAGE_ROOTS:
        if not _STAGE_ROOTS:
            atexit.register(remove_stage_tables)
        _STAGE_ROOTS[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def remove_stage_tables() -> None:
    """Delete what this driver's applications staged; results read from there
    must have been written by then."""
    for root, spark in list(_STAGE_ROOTS.items()):
        del _STAGE_ROOTS[root]
        try:
            drop_stage(spark, root)
        except Exception:  # noqa: BLE001 - the session is gone; the folder is left to the cluster
            pass


def table(spark: SparkSession, sf_dir: str, name: str):
    """Read one driver table; Catalyst prunes columns and pushes filters."""
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
