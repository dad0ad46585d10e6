"""Written intermediate tables in the shared folder, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.session import ensure_checkpoint_dir, range_partitions

#: Broadcast a side only when it was counted to hold at most so many bytes.
BROADCAST_BYTES = 16 << 20
#: Settings while a step is written; whole texts are long, so a batch to Python takes fewer rows.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
           "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the folder that ``spark.checkpoint.dir`` names, read again:
    it cuts the lineage, and a lost executor costs no recomputation of what stands before it. The
    shuffle files of the write are given back when it is done (a setting of Spark's own), so that a job
    of many steps holds those of one step at a time."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows fit ``BROADCAST_BYTES``; else as it is, for a
    shuffled join."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, order: list[Column], place: str, group: str | None = None, total: str | None = None) -> DataFrame:
    """``df`` with each row's ``place`` (from 0) in ``order``, within ``group`` (a column without nulls) if one is named,
    and the number of rows of the group as ``total``.

    Rows are dealt by ranges of the order, sorted and written once with running numbers, so a group
    of any size spans many tasks; what is summed up afterwards is one row per group and partition."""
    by = [F.col(group), *order] if group else order
    key = ["__part", group] if group else ["__part"]
    at = df.repartitionByRange(range_partitions(df), *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    at = table(at.withColumn("__part", F.shiftright("__at", 33)), "numbered")
    runs = at.groupBy(*key).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(group) if group else Window.partitionBy()
    before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*key, (before - F.col("__first")).alias("__shift"), F.sum("__n").over(w).alias("__total"))
    out = at.join(small_side(table(runs, "runs"), 64), key).withColumn(place, F.col("__at") + F.col("__shift"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__part", "__at", "__shift", "__total")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest id reachable from each id of ``edges`` (a, b): rows (id, root).

    Every round links each node to the smallest neighbour of its root and then jumps to the
    root's root, so the rounds grow with the logarithm of a component's diameter. Each
    round is written to the shared folder. A node with a third of all edges is one group of a
    pre-aggregated minimum, so it never meets in one task."""
    e = edges.where("a <> b and a is not null and b is not null")
    e = table(e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    root = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root"))
    root = table(root, name)
    while True:
        # the smallest root seen next to any node of a tree is offered to that tree's root
        near = (e.join(root.select(F.col("id").alias("b"), F.col("root").alias("r")), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("r").alias("near")))
        seen = root.join(near, "id", "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("best"))
        offer = seen.groupBy(F.col("root").alias("id")).agg(F.min("best").alias("offer"))
        hooked = table(seen.join(offer, "id", "left").select(
            "id", "root", F.least("best", F.coalesce("offer", "best")).alias("best")), name)
        up = hooked.select(F.col("id").alias("best"), F.col("best").alias("top"))
        after = table(hooked.join(up, "best", "left").select(
            "id", F.col("root").alias("before"), F.least("best", F.coalesce("top", "best")).alias("root")), name)
        if after.where("before <> root").limit(1).count() == 0:
            return after.select("id", "root")
        root = after.select("id", "root")
