"""Relational table jobs on the chunk table: departments, statistics, running totals,
numbering, usage, the document-department graph, chat context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import DRIVER_FINANCE_SOURCES, DRIVER_IT_SOURCES, HISTORY_MESSAGES


def with_department(chunks: DataFrame, it=DRIVER_IT_SOURCES, finance=DRIVER_FINANCE_SOURCES) -> DataFrame:
    """Department of each row from its source (searched CASE with IN lists)."""
    dept = (F.when(F.col("source").isin(list(it)), "IT")
            .when(F.col("source").isin(list(finance)), "Finance").otherwise("HR"))
    return chunks.withColumn("department", dept)


def department_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("department").agg(F.countDistinct("source").alias("documents"),
                                            F.count(F.lit(1)).alias("chunks"))


def document_stats(chunks: DataFrame) -> DataFrame:
    """One row per document: chunk count and mean chunk length (double, 6 places)."""
    return chunks.groupBy("source", "department").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.round(F.avg(F.length("content")).cast("double"), 6).alias("avg_chunk_length"))


def rank_desc(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """``RANK() OVER (ORDER BY value DESC)`` of a number, without a window over all rows or over all values in one task.

    Rank = 1 + rows with a larger value. The rows per distinct value are counted first (partial aggregation); the running
    count over the values goes by range partitions and their sums (``running_total``), and is joined back on the value."""
    from lodestar.operators.sequence import running_total
    per_value = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).select(value, "_n", F.lit(0).alias("_all"), (-F.col(value)).alias("_down"))
    upto = running_total(per_value, "_all", ["_down"], "_n", "_upto")
    ranks = upto.select(value, (F.col("_upto") - F.col("_n") + 1).cast("long").alias(name))
    return df.join(ranks, value)


def running_totals(stats: DataFrame) -> DataFrame:
    """Running chunk total per department in source order (ROWS UNBOUNDED PRECEDING) and size rank;
    a department owning most documents is still spread over many tasks (``running_total``)."""
    from lodestar.operators.sequence import running_total
    out = running_total(stats.select("department", "source", "chunks"), "department", ["source"], "chunks",
                        "running_total_in_department")
    return rank_desc(out, "chunks", "size_rank")


def dense_index(df: DataFrame, order: list[str], name: str = "n", start: int = 0) -> DataFrame:
    """Zero-based (or ``start``-based) row number in ``order`` without a single-partition window.

    Only the order columns are range-partitioned and numbered, with offsets by partition (``numbered_rows``); the
    rows meet their numbers in a join."""
    from lodestar.operators.sequence import numbered_rows
    return numbered_rows(df, [], order, name).withColumn(name, F.col(name) - 1 + F.lit(start).cast("long"))


def usage_rows(events: DataFrame, sources: DataFrame) -> DataFrame:
    """What happened when and where: ``used_on, source, mode, shift, duration_ms`` of every event.

    A user works on one document, the one whose index is ``user_id % number of documents`` (a join on a computed key; users that
    are null or negative have none and their events stay without a source). ``shift`` is the third of the day."""
    docs = dense_index(sources.select("source").distinct(), ["source"], "n")
    total = docs.select(F.count(F.lit(1))).scalar()
    third = F.floor(F.hour("ts") / 8)
    shift = F.when(third == 0, "night").when(third == 1, "day").when(third == 2, "evening")
    rows = events.select(F.to_date("ts").alias("used_on"), F.col("event_type").alias("mode"), shift.alias("shift"),
                         F.round("value", 2).alias("duration_ms"), (F.col("user_id") % total).alias("n"))
    # docs has one row per distinct source; Catalyst broadcasts it when its size allows.
    return rows.join(docs, "n", "left").select("used_on", "source", "mode", "shift", "duration_ms")


def usage_by_month(usage: DataFrame) -> DataFrame:
    """Events and mean duration of every mode in every month from the first to the last, months without any included.

    The calendar is a number sequence over one row (first month, last month, modes), so it grows with months x modes only."""
    month = F.trunc("used_on", "month")
    seen = (usage.where("used_on is not null and mode is not null").groupBy(month.alias("month"), "mode")
            .agg(F.count(F.lit(1)).alias("searches"), F.round(F.avg("duration_ms"), 6).alias("avg_ms")))
    ends = seen.agg(F.min("month").alias("lo"), F.max("month").alias("hi"), F.collect_set("mode").alias("modes"))
    numbers = F.sequence(F.lit(0), F.months_between("hi", "lo").cast("int"))
    calendar = ends.where("lo is not null").select("lo", "modes", F.explode(numbers).alias("k"))
    calendar = calendar.select(F.add_months("lo", F.col("k")).alias("month"), F.explode("modes").alias("mode"))
    return (calendar.join(seen, ["month", "mode"], "left")
            .select("month", "mode", F.coalesce("searches", F.lit(0)).alias("searches"), "avg_ms").orderBy("month", "mode"))


def graph_edges(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Document nodes, department nodes and ``owned_by`` edges, derived from the rows."""
    documents = chunks.select(F.col("source").alias("name")).distinct()
    departments = chunks.select(F.col("department").alias("name")).distinct()
    owned_by = chunks.select(F.col("source").alias("src"), F.col("department").alias("dst")).distinct()
    return documents, departments, owned_by


def same_department_as(owned_by: DataFrame, document: Column | str) -> DataFrame:
    """Two-hop match ``doc -(owned_by)-> dept <-(owned_by)- other`` for one document, other ≠ doc."""
    doc = F.lit(document) if isinstance(document, str) else document
    o1 = owned_by.where(F.col("src") == doc).select(F.col("src").alias("doc"), F.col("dst").alias("department"))
    o2 = owned_by.select(F.col("src").alias("other"), F.col("dst").alias("department"))
    return (o1.join(o2, "department").where(F.col("other") != F.col("doc"))
            .select(F.col("other").alias("same_department"), "department"))


def first_per_group(df: DataFrame, group: str, order: str, value: str, n: int = 4) -> DataFrame:
    """First ``value`` of each group in ``order``, then the first n groups by that order.

    The first row per group is an aggregate (``min_by``, partial per partition), so a
    large group is never sorted in one task."""
    firsts = df.groupBy(group).agg(F.min_by(F.struct(order, value), order).alias("_f")).select(group, "_f.*")
    return firsts.orderBy(order).limit(n).select(group, order, value)


def chat_history(messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """For each message, the n messages before it in its conversation as
    ``array<struct<role, content>>`` (oldest first), also for a conversation with a
    large share of all messages (``sequence_context``)."""
    from lodestar.operators.sequence import sequence_context
    msgs = messages.select("conv_id", "turn", "role", F.col("text").alias("content"))
    return sequence_context(msgs, "conv_id", ["turn"], ["role", "content"], n).select("conv_id", "turn", "role", "history")
