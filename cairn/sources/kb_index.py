"""The stored search index of the knowledge base, brought up to date after a
refresh without reading unchanged cases again.

An index is a folder of versions. ``full-N`` holds all cases, ``part-N`` those that came
with version N and the ids of those that went. In force are the latest full
version and the parts after it; an id that went with version N is gone from
every earlier version. A version counts once its postings are written to the end, so a failed
update leaves the index as it was. Cases are known by their content: an unchanged one keeps its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.search import case_counts
from cairn.plans.guard import broadcast_if_small, fits
from cairn.session import write_stage, written_folders
from cairn.sources.kb import KB_COLUMNS

MAX_PARTS, MAX_GONE_SHARE = 8, 0.25
"""A merge follows an update that leaves more parts than this, or more dead cases in the versions in force."""
POSTINGS = "case_id long, dl long, term string, tf long"


def case_key(columns=KB_COLUMNS) -> Column:
    """The id of a case: 60 bits of the digest of its cells. Equal rows are one case."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *cells), 256), 1, 15), 16, 10).cast("long")


def _rows_of(rows: DataFrame, wanted: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of ``wanted`` ids. All other ids are in ``others``: the shorter list is sent to
    the rows, so that their texts are shuffled only if both are long."""
    if not fits(wanted) and fits(others):
        return rows.where(F.col("case_id").isNotNull()).join(F.broadcast(others), "case_id", "left_anti")
    return rows.join(broadcast_if_small(wanted), "case_id", "left_semi")


class CaseIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[tuple[int, str]]:
        """(number, kind) of the versions in force, oldest first."""
        names = (f.partition("-") for f in written_folders(self.spark, self.root, "postings"))
        found = [(int(number), kind) for kind, _, number in names]
        found.sort()
        last_full = max((i for i, (_, kind) in enumerate(found) if kind == "full"), default=0)
        return found[last_full:]

    def _read(self, what: str, schema: str) -> DataFrame:
        tables = [self.spark.read.schema(schema).parquet(f"{self.root}/{kind}-{n}/{what}").withColumn("version", F.lit(n))
                  for n, kind in self.versions() if what == "postings" or kind == "part"]
        out = self.spark.createDataFrame([], f"{schema}, version int")
        for t in tables:
            out = out.unionByName(t)
        return out

    def index(self) -> DataFrame:
        """(case_id, dl, term, tf) of the cases in force; a row with a NULL term per case."""
        gone = self._read("gone", "case_id long").groupBy("case_id").agg(F.max("version").alias("until"))
        rows = self._read("postings", POSTINGS).join(broadcast_if_small(gone), "case_id", "left")
        return rows.where(F.col("until").isNull() | (F.col("version") >= F.col("until"))).drop("version", "until")

    def update(self, cases: DataFrame, text_col: str = "explanation") -> dict:
        """Brings the index to the state of ``cases`` (case_id and the text). Only texts of
        cases that it does not hold are tokenised. Returns the numbers of cases added and removed."""
        live = write_stage(self.index().where(F.col("term").isNull()).select("case_id"), "kb-live")
        ids = cases.groupBy("case_id").agg((F.count(F.lit(1)) == 1).alias("once"))
        ids = write_stage(ids.join(live.withColumn("held", F.lit(True)), "case_id", "left"), "kb-ids")
        number = max((n for n, _ in self.versions()), default=-1) + 1
        at = f"{self.root}/part-{number}"
        live.join(ids, "case_id", "left_anti").write.mode("overwrite").parquet(f"{at}/gone")

        def texts(where: str) -> DataFrame:
            return _rows_of(cases.select("case_id", text_col), ids.where(where).select("case_id"), ids.where(f"NOT ({where})").select("case_id"))
        new = texts("held IS NULL AND once").unionByName(texts("held IS NULL AND NOT once").dropDuplicates(["case_id"]))
        case_counts(new, "case_id", text_col).write.mode("overwrite").parquet(f"{at}/postings", compression="zstd")
        postings = self.spark.read.schema(POSTINGS).parquet(f"{at}/postings")
        done = {"added": postings.where(F.col("term").isNull()).count(),
                "removed": self.spark.read.schema("case_id long").parquet(f"{at}/gone").count()}
        parts = sum(kind == "part" for _, kind in self.versions())
        if parts > MAX_PARTS or (done["removed"] and self._dead_share() > MAX_GONE_SHARE):
            self.merge()
        return done

    def _dead_share(self) -> float:
        dead, live = self._read("gone", "case_id long").count(), self.index().where(F.col("term").isNull()).count()
        return dead / max(live, 1)

    def merge(self) -> None:
        """One full version in place of those in force, without the cases that went."""
        number = max((n for n, _ in self.versions()), default=-1) + 1
        self.index().write.mode("overwrite").parquet(f"{self.root}/full-{number}/postings", compression="zstd")
