"""Word counting: tokenize, count, rank, filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import words_of

# Fixed values of the reference job.
FREQUENT_THRESHOLD = 1000  # strict: count > 1000
TOP_K = 10


def tokenize(lines: DataFrame, line_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per word. Case-sensitive, punctuation kept, empty words kept.

    With ``keep`` the listed columns are carried along and a 1-based
    ``word_no`` is added; without it the output is the single column ``word``.
    """
    if not keep:
        return lines.select(F.explode(words_of(F.col(line_col))).alias("word"))
    return (lines.select(*keep, F.posexplode(words_of(F.col(line_col))).alias("_pos", "word"))
            .select(*keep, (F.col("_pos") + 1).cast("long").alias("word_no"), "word"))


def word_count(words: DataFrame) -> DataFrame:
    """``(word, count)``; partial aggregation before the shuffle on ``word``."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def sort_by_count(counts: DataFrame) -> DataFrame:
    """Global order by count descending; ties broken by word (the reference
    leaves them open)."""
    return counts.orderBy(F.col("count").desc(), F.col("word").asc())


def top_words(counts: DataFrame, k: int = TOP_K) -> DataFrame:
    """First ``k`` of :func:`sort_by_count`; planned as TakeOrderedAndProject,
    so each task keeps only its own top ``k``."""
    return sort_by_count(counts).limit(k)


def frequent_words(counts: DataFrame, threshold: int = FREQUENT_THRESHOLD) -> DataFrame:
    return counts.where(F.col("count") > threshold)


def distinct_word_count(counts: DataFrame) -> DataFrame:
    """Number of distinct words (``''`` included), as a one-row DataFrame."""
    return counts.agg(F.count(F.lit(1)).alias("distinct_words"))


def frequent_word_count(counts: DataFrame, threshold: int = FREQUENT_THRESHOLD) -> DataFrame:
    return frequent_words(counts, threshold).agg(F.count(F.lit(1)).alias("frequent_words"))


def partition_report(df: DataFrame) -> DataFrame:
    """One row: ``partitions`` (empty ones included) and ``rows`` of ``df``.
    Every task reports once, also one without rows."""
    def count(batches):
        import pandas as pd
        yield pd.DataFrame({"rows": [sum(len(b) for b in batches)]})

    return df.select(F.lit(1).alias("one")).mapInPandas(count, "rows long").agg(
        F.count(F.lit(1)).alias("partitions"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
