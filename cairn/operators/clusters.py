"""Cluster lookup by exact name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.guard import broadcast_if_small


def cluster_lookup(requests: DataFrame, clusters: DataFrame, name_col: str = "cluster_name",
                   max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """``(request_name, status, details)``: exact, case-sensitive match ->
    'ok' + details; otherwise 'not found' and NULL details. The cluster
    side is broadcast only when a bounded count proves it small."""
    c = broadcast_if_small(clusters.select(F.col(name_col).alias("_name"), "details"), max_broadcast_rows)
    j = requests.join(c, requests[name_col] == c["_name"], "left")
    found = F.col("_name").isNotNull()
    return j.select(F.col(name_col).alias("request_name"),
                    F.when(found, "ok").otherwise("not found").alias("status"),
                    F.when(found, F.col("details")).alias("details"))
