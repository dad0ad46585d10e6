"""A table by key of which a change rewrites only the buckets it touches.

Rows are dealt into ``buckets`` by a hash of the key. A batch of changes is merged with the buckets its keys fall into, those are written
under the batch's own folder, and a manifest (``ingest.publish``) says where every bucket stands now. What is written
grows with the batch and not with the table; the other buckets stay where they are. A batch that was published already is
left out, one that failed half-way writes its folder again. Old folders stay for readers of earlier manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.ingest import manifest, publish

BUCKETS = 64


class BucketTable:
    def __init__(self, spark: SparkSession, base: str, key: str, schema, buckets: int = BUCKETS):
        """``schema``: of the rows; ``buckets`` counts when the table is first written."""
        self.spark, self.base, self.key, self.schema = spark, base.rstrip("/"), key, schema
        now = manifest(spark, self.base)
        self.buckets = now["buckets"] if now else buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _state(self) -> dict:
        return manifest(self.spark, self.base) or {"places": {}, "batch": None}

    def _read(self, places: list[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*places)

    def table(self) -> DataFrame:
        """All rows as the newest manifest has them: one folder per bucket that was ever written."""
        return self._read(sorted(self._state()["places"].values()))

    def exists(self) -> bool:
        return manifest(self.spark, self.base) is not None

    def apply(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Publishes ``merge(rows of the touched buckets, batch)`` as batch ``number``; False if it was published before."""
        state = self._state()
        if state["batch"] is not None and number <= state["batch"]:
            return False
        touched = sorted(r[0] for r in batch.select(self._bucket()).distinct().collect())  # at most ``buckets`` numbers
        rows = self._read([state["places"][str(b)] for b in touched if str(b) in state["places"]])
        path = f"{self.base}/batch={number}"
        merge(rows, batch).withColumn("_bucket", self._bucket()).repartition("_bucket") \
            .write.mode("overwrite").partitionBy("_bucket").parquet(path)
        places = state["places"] | {str(b): f"{path}/_bucket={b}" for b in touched}
        publish(self.spark, self.base, path, places=places, batch=number, buckets=self.buckets)
        return True
