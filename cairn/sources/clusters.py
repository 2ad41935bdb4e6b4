"""Cluster listings (JSON pages) -> cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTING_SCHEMA = "struct<clusters: array<struct<clusterName: string>>>"


def cluster_names(listings: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per ``clusters[].clusterName`` of every listing page; a page
    without ``clusters`` yields no rows."""
    parsed = listings.withColumn("_l", F.from_json(F.col(body_col), LISTING_SCHEMA))
    return (parsed.select(*[c for c in listings.columns if c != body_col],
                          F.explode("_l.clusters").alias("_c"))
            .select(*[c for c in listings.columns if c != body_col],
                    F.col("_c.clusterName").alias("cluster_name")))


def cluster_records(listings: DataFrame, record_schema: str, body_col: str = "body") -> DataFrame:
    """Cluster records of every listing page, with ``details`` = the record as JSON."""
    parsed = listings.withColumn("_l", F.from_json(F.col(body_col), f"struct<clusters: array<{record_schema}>>"))
    return (parsed.select(F.explode("_l.clusters").alias("_c"))
            .select(F.col("_c.clusterName").alias("cluster_name"), F.to_json("_c").alias("details")))
