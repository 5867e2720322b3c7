"""Keys that earlier micro-batches have seen, as a stored table by key hash.

A batch looks up its own keys in the buckets they fall into and writes its new keys there. Every ``merge`` batches the keys so far
are written together, so a look-up opens the last merge and the few batches after it, however long the stream has run.
Folders are named by batch number and overwritten when a batch is repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyTable:
    """``key`` and the number of the last batch that has added it, below ``path``."""

    spark: SparkSession
    path: str
    key_type: str = "string"
    buckets: int = 64
    merge: int = 16

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        schema = f"key {self.key_type}, batch BIGINT, part STRING, bucket INT"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders)

    def folders(self, batch_id: int) -> list[str]:
        """Where the keys of the batches before ``batch_id`` lie."""
        merged = batch_id // self.merge * self.merge
        return ([f"{self.path}/part=m{merged}"] if merged else []) + [f"{self.path}/part=b{i}" for i in range(merged, batch_id)]

    def earlier(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """(key, batch) of those of the distinct ``keys`` (key) that an earlier batch has added."""
        rows = keys.where("key IS NOT NULL").select("key").distinct().withColumn("bucket", self._bucket())
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        seen = self._read(self.folders(batch_id)).where(F.col("bucket").isin(touched)).join(rows, ["bucket", "key"])
        return seen.groupBy("key").agg(F.max("batch").alias("batch"))

    def add(self, keys: DataFrame, batch_id: int) -> None:
        """Store the distinct ``keys`` (key) of a batch."""
        rows = keys.where("key IS NOT NULL").select("key").distinct().withColumn("batch", F.lit(batch_id).cast("bigint"))
        self._write(rows.withColumn("bucket", self._bucket()), f"{self.path}/part=b{batch_id}")
        if (batch_id + 1) % self.merge == 0:
            all_rows = self._read(self.folders(batch_id) + [f"{self.path}/part=b{batch_id}"])
            self._write(all_rows.groupBy("bucket", "key").agg(F.max("batch").alias("batch")), f"{self.path}/part=m{batch_id + 1}")

    def _write(self, rows: DataFrame, folder: str) -> None:
        laid = rows.select("key", "batch", "bucket").hint("rebalance", "bucket")
        laid.write.mode("overwrite").partitionBy("bucket").parquet(folder)
