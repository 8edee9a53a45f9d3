"""A table that a stream upserts into: the last row of a key wins, replays change nothing, old versions are folded together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UpsertTable:
    """Parquet files in `path`/data, a folder a version, and a list of the versions that count. One writer at a time.

    A batch is written to the folder of its own number, then listed: a batch that is
    written again after a failure replaces its folder, and one already listed or folded
    is left alone. Readers see listed versions only.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...]

    def _listed(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        schema = "version long, folder string, folds array<string>"
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/versions")

    def versions(self) -> dict[str, int]:
        """Folders that count and the last batch each holds; a row a version."""
        rows = self._listed().collect()
        folded = {f for r in rows for f in r["folds"]}
        return {r["folder"]: r["version"] for r in rows if r["folder"] not in folded}

    def _list(self, version: int, folder: str, folds: list[str]) -> None:
        self.spark.createDataFrame([(version, folder, folds)], "version long, folder string, folds array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def _last(self, df: DataFrame, order: list[str]) -> DataFrame:
        """The last row of each key; its other columns decide between rows that tie."""
        rest = [c for c in df.columns if c not in (*self.keys, *order)]
        return df.groupBy(*self.keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order, *rest)).alias("__r")).select("__r.*")

    def upsert(self, batch: DataFrame, batch_id: int) -> bool:
        """Write a batch, for foreachBatch; False if it was written before."""
        rows = self._listed().collect()  # a row a version
        if any(r["folder"] == f"batch-{batch_id}" for r in rows):
            return False
        self._last(batch, list(self.order)).write.mode("overwrite").parquet(f"{self.path}/data/batch-{batch_id}")
        self._list(batch_id, f"batch-{batch_id}", [])
        return True

    def read(self) -> DataFrame | None:
        """The last row of each key over all versions; None before the first batch."""
        found = self.versions()
        if not found:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/data/{folder}").withColumn("__version", F.lit(v).cast("long")) for folder, v in found.items()]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        return self._last(rows, ["__version", *self.order]).drop("__version")

    def compact(self) -> None:
        """Fold all versions into one; replays of batches that went into it stay without effect."""
        found = self.versions()
        if len(found) < 2:
            return
        last = max(found.values())
        folder = f"folded-{last}-{len(self._listed().collect())}"
        self.read().write.mode("overwrite").parquet(f"{self.path}/data/{folder}")
        self._list(last, folder, sorted(found))

    def vacuum(self) -> None:
        """Remove the files of versions that were folded."""
        for r in self._listed().select(F.explode("folds").alias("f")).distinct().collect():
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{r['f']}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
