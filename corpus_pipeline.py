"""The text-preparation pipeline: toxic documents go, one document of each
group of near copies stays, repeated passages are cut out, contaminated
documents go, and what is left is packed.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes each
result as Parquet below ``spark.checkpoint.dir`` and gives the table that is
read back to the next stage. All stages but the last return the columns
of ``docs``; null and empty texts pass them unchanged, and an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import checked_broadcast, table, with_rows, write_stage
from cairn.llm.decontamination import search_benchmark
from cairn.llm.ngram_join import ngram_join
from cairn.llm.packing import pack_documents
from cairn.llm.suffix_dedup import cut_repeats
from cairn.llm.toxicity import THRESHOLD, toxicity

NEAR_WORDS, NEAR_PERCENT = 5, 80
REPEAT_BYTES = 240
"""Shortest repeated string that is cut: about 45 words."""


def _numbered(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(row number as doc_id, text) of ``rows``, the numbered form of ``docs``."""
    return rows.select(F.col("row").alias("doc_id"), F.col(f"c{docs.columns.index('text')}").alias("text"))


def _without(rows: DataFrame, gone: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows``, the numbered form of ``docs``, without those whose numbers are in
    ``gone``, in the columns of ``docs``."""
    return rows.join(checked_broadcast(gone), "row", "left_anti").drop("row").toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    ids = docs.columns.index("doc_id")
    inner = [c if c in ("text", "doc_id") else f"_c{i}" for i, c in enumerate(docs.columns)]
    scored = toxicity(docs.toDF(*inner), table(spark, sf_dir, "labels"), keep=tuple(inner))
    assert inner[ids] == "doc_id"
    return scored.filter(F.col("score") < THRESHOLD).select(*inner).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; texts without words all stay."""
    rows = with_rows(docs, "pipeline-rows")
    grouped, _ = ngram_join(_numbered(rows, docs), NEAR_WORDS, NEAR_PERCENT)
    gone = write_stage(grouped.filter("doc_id <> component_id").select(F.col("doc_id").alias("row")), "pipeline-near")
    return _without(rows, gone, docs)


def cut_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that occur again in the table; n_chars follows."""
    cut = cut_repeats(docs, REPEAT_BYTES)
    return cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit(""))).cast("long")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = with_rows(docs, "pipeline-rows")
    found = search_benchmark(_numbered(rows, docs), table(spark, sf_dir, "benchmark"))
    gone = write_stage(found.filter("contaminated").select(F.col("doc_id").alias("row")).distinct(), "pipeline-leaks")
    return _without(rows, gone, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeated),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
