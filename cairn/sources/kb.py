"""The knowledge-base sheet (external CSV) and its native copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import staging_path
from cairn.sources.sheet import read_sheet

# Fixed values of the knowledge-base table definition.
KB_COLUMNS = ("product", "updated_at", "category", "explanation", "solution")
KB_MAX_BAD_RECORDS = 1
KB_SKIP_LEADING_ROWS = 1

KB_SCHEMA = T.StructType([
    T.StructField("product", T.StringType(), True),
    T.StructField("updated_at", T.DateType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("explanation", T.StringType(), True),
    T.StructField("solution", T.StringType(), True),
])


class BadRecordBudgetExceeded(ValueError):
    pass


def kb_sheet_scan(spark: SparkSession, path: str, max_bad_records: int = KB_MAX_BAD_RECORDS, parsed: str | None = None) -> DataFrame:
    """Read the sheet export: one header row per file, explicit schema,
    unknown extra columns ignored, short rows padded with NULL, multi-line
    quoted cells. A record is bad when its date does not parse; bad records
    are skipped, and more than ``max_bad_records`` of them fail the scan. The
    sheet is parsed once into a native table (the folder ``parsed``, if given, which the caller
    may drop), on which the check runs; ``path`` is not read later. Files are
    split over tasks, whatever line breaks their cells hold (:mod:`cairn.sources.sheet`)."""
    raw = read_sheet(spark, path, T.StructType([T.StructField(c, T.StringType(), True) for c in KB_COLUMNS]), KB_SKIP_LEADING_ROWS)
    typed = raw.withColumn("_date", F.col("updated_at").try_cast("date"))
    parsed = parsed or staging_path(spark, "kb-sheet")
    typed.write.parquet(parsed, compression="zstd")
    typed = spark.read.parquet(parsed)
    bad = F.col("updated_at").isNotNull() & F.col("_date").isNull()
    n_bad = typed.where(bad).limit(max_bad_records + 1).count()
    if n_bad > max_bad_records:
        raise BadRecordBudgetExceeded(
            f"{n_bad if n_bad <= max_bad_records else 'more than ' + str(max_bad_records)} bad records; "
            f"budget is {max_bad_records}")
    return typed.where(~bad).select("product", F.col("_date").alias("updated_at"), "category",
                                    "explanation", "solution")


def kb_refresh(cases: DataFrame, native_path: str) -> DataFrame:
    """Full reload of the native table from the external scan; returns the
    native table as read back. ``native_path`` must not be read by ``cases``."""
    cases.write.mode("overwrite").parquet(native_path, compression="zstd")
    return cases.sparkSession.read.parquet(native_path)
