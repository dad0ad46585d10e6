"""Position and preceding rows within a key, for keys of any size.

``row_number`` / ``lag`` / a ``ROWS n PRECEDING`` frame over ``PARTITION BY key``
puts a whole key into one task. Here only the keys are numbered (``points``): one
row per distinct (key, order), range-partitioned, so a key with a third of the rows
is spread over many partitions, with the sums of the partitions before it as
offsets. Texts and vectors are neither sorted nor checkpointed; they meet their
number in a join on (key, order). The preceding rows come from blocks of
``BLOCK`` positions, each with copies of the last n rows of the block before it.

Rows that tie in (key, order) are numbered in the order of a hash of their columns,
so a recomputed task numbers them alike. Null keys and null orders count as values
of their own (nulls first).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import range_partitions

BLOCK = 1024  # positions in a block of preceding rows


def points(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per distinct (key, order): these columns, and ``_before``, the rows of the key that come earlier.

    Only these columns and a count are checkpointed, with the partition they lie in, which all branches of the plan
    must see alike. Their values must be the same whenever ``df`` is computed."""
    counted = df.groupBy(*key, *order).agg(F.count(F.lit(1)).alias("_n"))
    parted = counted.repartitionByRange(range_partitions(df), *key, *order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("_pid", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parted.withColumn("_in", F.sum("_n").over(inside) - F.col("_n"))
    # One row per partition and key; over the partitions of one key (at most their number) runs the offset.
    earlier = Window.partitionBy(*key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = parted.groupBy("_pid", *key).agg(F.sum("_n").alias("_s"))
    seg = seg.select("_pid", *key, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_off"))
    out = _meet(local, seg, ["_pid", *key])
    return out.select(*key, *order, (F.col("_off") + F.col("_in")).alias("_before"))


def _meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal columns, null equal to null, with the columns of ``left`` and the new ones of ``right``."""
    names = {c: f"_r_{i}" for i, c in enumerate(on)}
    right = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(names[c])) for c in on])
    return left.join(right, same).drop(*names.values())


def numbered_rows(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` plus ``name``, the 1-based position within ``key`` (all rows, if empty) in ``order``; it replaces a column
    of that name. ``df`` is computed twice, the first time for its keys alone; write a costly one before."""
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    ties = Window.partitionBy(*key, *order).orderBy(F.xxhash64(*[F.col(c) for c in hashed]))
    out = _meet(df, points(df, key, order), [*key, *order]).withColumn("_tie", F.row_number().over(ties))
    return out.select(*[c for c in df.columns if c != name], (F.col("_before") + F.col("_tie")).cast("long").alias(name))


def sequence_context(df: DataFrame, key: str, order: list[str], carry: list[str], n_prev: int, *,
                     position: str = "position", history: str = "history") -> DataFrame:
    """``df`` plus ``position`` (1-based within ``key`` in ``order``) and ``history``: the
    ``carry`` columns of up to ``n_prev`` preceding rows, oldest first, as ``array<struct>``."""
    size = max(BLOCK, n_prev)
    rows = numbered_rows(df, [key], order, position)
    at = F.col(position) - 1
    block = F.floor(at / size)
    # The last n rows of a block are also sent to the next one.
    sent = rows.withColumn("_block", block).withColumn("_to", F.explode(
        F.when(at % size >= size - n_prev, F.array(block, block + 1)).otherwise(F.array(block))))
    w = Window.partitionBy(key, "_to").orderBy(position).rowsBetween(-n_prev, -1)
    out = sent.withColumn(history, F.collect_list(F.struct(*[F.col(c) for c in carry])).over(w))
    return out.where(F.col("_block") == F.col("_to")).select(*[c for c in df.columns if c != position], position, history)


def running_total(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY key ORDER BY order ROWS UNBOUNDED PRECEDING)`` for keys of any size:
    a running sum inside each range partition plus the sums of the key's earlier segments."""
    parted = df.repartitionByRange(range_partitions(df), key, *order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy("_pid", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parted.withColumn("_ls", F.sum(value).over(w))
    seg = parted.groupBy("_pid", key).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select("_pid", key, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    return _meet(local, seg, ["_pid", key]).select(*df.columns, (F.col("_off") + F.col("_ls")).alias(out))
