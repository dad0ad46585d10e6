"""Change data as table jobs: snapshot diffs, update audits, row history, latest state, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import range_partitions

OPEN_END = "9999-12-31 23:59:59.999999"


def snapshot_changes(old: DataFrame, new: DataFrame, key: str = "id", value: str = "content") -> DataFrame:
    """Rows changed between two snapshots: ``key, operation`` (I insert, U update, D delete).

    Values are compared by hash, so only the digests meet in the join. A null value is a value:
    presence is told by a flag, not by the digest."""
    o = old.select(F.col(key).alias("_k"), F.sha2(F.col(value), 256).alias("_o"), F.lit(True).alias("_was"))
    n = new.select(F.col(key).alias("_k"), F.sha2(F.col(value), 256).alias("_n"), F.lit(True).alias("_is"))
    d = o.join(n, "_k", "full")
    op = (F.when(F.col("_was").isNull(), "I").when(F.col("_is").isNull(), "D")
          .when(~F.col("_o").eqNullSafe(F.col("_n")), "U"))
    return d.select(F.col("_k").alias(key), op.alias("operation")).where(F.col("operation").isNotNull())


def changed_rows(old: DataFrame, new: DataFrame, key: str = "id", value: str = "content",
                 keep=("source",)) -> DataFrame:
    """The rows to re-embed: changes joined to the current rows (deleted rows drop out)."""
    ch = snapshot_changes(old, new, key, value)
    return new.select(key, *keep).join(ch, key)


def update_audit(before: DataFrame, after: DataFrame, key: str, value: str,
                 changed_at: Column | None = None) -> DataFrame:
    """One audit row per updated row, also when the value did not change."""
    b = before.select(F.col(key).alias("_k"), F.col(value).alias("old_value"))
    a = after.select(F.col(key).alias("_k"), F.col(value).alias("new_value"))
    out = a.join(b, "_k").select(F.col("_k").alias(key), "old_value", "new_value")
    return out.withColumn("changed_at", changed_at if changed_at is not None else F.current_timestamp())


def next_in_key(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """``LEAD(value) OVER (PARTITION BY key ORDER BY order)`` that also holds for a key
    owning a large share of the rows.

    Rows are range-partitioned on (key, order), so a hot key spreads over several
    partitions; ``lead`` runs inside each partition, and the last row of a key in a
    partition takes its successor from the first row of the next non-empty
    partition (one row per partition, a bounded side)."""
    parted = df.repartitionByRange(range_partitions(df), key, *order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy("_pid", key).orderBy(*order)
    local = parted.withColumn(out, F.lead(value).over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    first = (parted.groupBy("_pid")
             .agg(F.min_by(F.struct(F.col(key).alias("_fk"), F.col(value).alias("_fv")),
                           F.struct(*[F.col(c) for c in [key, *order]])).alias("_f")))
    nxt = first.select((F.lag("_pid").over(Window.orderBy("_pid"))).alias("_prev"), "_f._fk", "_f._fv")
    nxt = nxt.where(F.col("_prev").isNotNull())
    fixed = local.join(F.broadcast(nxt), (local["_pid"] == nxt["_prev"]) & (local[key] == nxt["_fk"])
                       & local["_last"], "left")
    return fixed.select(*df.columns, F.when(F.col("_last"), F.col("_fv")).otherwise(F.col(out)).alias(out))


def chained_audit(before: DataFrame, updates: DataFrame, key: str, value: str, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Audit of ``updates`` that may hold several rows per key, and each key's last value (``key, value``).

    The updates of a key form a chain in ``order`` (ties, and no order at all: by value): the first replaces the row's value, each later one
    what its predecessor wrote. Keys that have no row are not audited. A key's updates of one batch are one ordered array."""
    rank = F.struct(*(order or []), F.col(value))
    chain = updates.groupBy(key).agg(F.sort_array(F.collect_list(rank)).alias("_c"))
    chain = chain.select(key, F.transform("_c", lambda x: x[value]).alias("_v"))
    rows = before.select(key, F.col(value).alias("_old")).join(chain, key)
    steps = rows.select(key, "_v", F.concat(F.array("_old"), F.slice("_v", 1, F.size("_v") - 1)).alias("_b"))
    audit = steps.select(key, F.inline(F.arrays_zip(F.col("_b").alias("old_value"), F.col("_v").alias("new_value"))))
    return audit, chain.select(key, F.element_at("_v", -1).alias(value))


def version_history(versions: DataFrame, key: str, ts: str, cols: list[str], tie: str | None = None) -> DataFrame:
    """Row history with ``valid_from`` / ``valid_to`` (open end for the current version)."""
    order = [ts] + ([tie] if tie else [])
    base = versions.select(key, *order, *[c for c in cols if c not in order and c != key])
    hist = next_in_key(base, key, order, ts, "valid_to")
    return hist.select(key, *[c for c in cols if c != key], F.col(ts).alias("valid_from"),
                       F.coalesce(F.col("valid_to"), F.to_timestamp_ntz(F.lit(OPEN_END))).alias("valid_to"))


def latest_per_key(df: DataFrame, key: str, ts: str, cols: list[str], tie: str | None = None) -> DataFrame:
    """The newest row per key (``max_by`` with partial aggregation; no per-key sort)."""
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    latest = F.max_by(F.struct(*[F.col(c) for c in cols], F.col(ts).alias("updated_at")), order)
    return df.groupBy(key).agg(latest.alias("_l")).select(key, "_l.*")


def upsert(target: DataFrame, source: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``MERGE``: matched keys take the source values, new keys are inserted, the rest kept;
    ``origin`` says which. Keys are unique on each side."""
    t = target.select(key, *[F.col(c).alias(f"_t_{c}") for c in cols], F.lit(True).alias("_in_t"))
    s = source.select(key, *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_in_s"))
    m = t.join(s, key, "full")
    origin = (F.when(F.col("_in_s").isNull(), "kept")
              .when(F.col("_in_t").isNull(), "inserted").otherwise("updated"))
    return m.select(key, *[F.when(F.col("_in_s"), F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c) for c in cols],
                    origin.alias("origin"))
