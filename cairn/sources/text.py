"""Text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import lines_of


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of the files under ``path``; column ``value``."""
    return spark.read.text(path)


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of a text column, exactly as the text source would split them:
    ``(id, line_no, value)`` with 1-based ``line_no``."""
    return (docs.select(F.col(id_col), F.posexplode(lines_of(F.col(text_col))).alias("_pos", "value"))
            .select(id_col, (F.col("_pos") + 1).cast("long").alias("line_no"), "value"))
