"""Registered change-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import changes as ch
from lodestar.plans.common import chunks
from lodestar.plans.registry import register
from lodestar.plans.sqlparts import CHUNKS
from lodestar.sources.tables import read_table

SUFFIX = " (uppfært)"


def _edited(c):
    """Two chunks of one document are edited: the first two by id of the lowest source."""
    first_src = c.select(F.min("source")).scalar()
    picked = c.where(F.col("source") == first_src).orderBy("id").limit(2).select("id", F.lit(True).alias("_e"))
    return (c.join(picked, "id", "left")
            .withColumn("content", F.when(F.col("_e"), F.concat("content", F.lit(SUFFIX))).otherwise(F.col("content")))
            .drop("_e"))


@register("changes_since", f"""WITH {CHUNKS},
upd AS (SELECT id FROM chunks WHERE source = (SELECT min(source) FROM chunks) ORDER BY id LIMIT 2),
new AS (SELECT id, source, CASE WHEN id IN (SELECT id FROM upd) THEN content || '{SUFFIX}' ELSE content END AS content FROM chunks),
diff AS (SELECT coalesce(n.id, o.id) AS id,
                CASE WHEN o.id IS NULL THEN 'I' WHEN n.id IS NULL THEN 'D' WHEN sha256(o.content) <> sha256(n.content) THEN 'U' END AS operation
         FROM chunks o FULL JOIN new n ON o.id = n.id)
SELECT n.id, n.source, d.operation FROM diff d JOIN new n ON n.id = d.id WHERE d.operation IS NOT NULL""")
def changes_since(spark, sf):
    old = chunks(spark, sf)
    return ch.changed_rows(old, _edited(old)).select("id", "source", "operation")


_FEEDBACK = "feedback AS (SELECT doc_id AS id, doc_id AS answer_id, CASE WHEN quality = 1 THEN 5 ELSE 2 END AS rating FROM labels)"


@register("update_audit", f"""WITH {_FEEDBACK}
SELECT id AS feedback_id, rating AS old_rating, 4 AS new_rating FROM feedback""")
def update_audit(spark, sf):
    fb = read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"),
                                                F.when(F.col("quality") == 1, 5).otherwise(2).alias("rating"))
    after = fb.withColumn("rating", F.lit(4))  # UPDATE feedback SET rating = 4
    audit = ch.update_audit(fb, after, "id", "rating")
    return audit.select(F.col("id").alias("feedback_id"), F.col("old_value").alias("old_rating"),
                        F.col("new_value").alias("new_rating"))


@register("version_history", """SELECT *, CASE WHEN valid_to < TIMESTAMP '9999-12-31 23:59:59.999999'
                                    THEN date_sub('second', valid_from, valid_to) END AS valid_seconds
FROM (SELECT user_id, event_type, value, ts AS valid_from,
  coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '9999-12-31 23:59:59.999999') AS valid_to
FROM events)""")
def version_history(spark, sf):
    """Row history, plus how long each closed version was valid in whole seconds."""
    ev = read_table(spark, sf, "events")
    hist = ch.version_history(ev, "user_id", "ts", ["event_type", "value"], tie="event_id")
    closed = F.col("valid_to") < F.to_timestamp_ntz(F.lit(ch.OPEN_END))
    return hist.withColumn("valid_seconds", F.when(closed, F.expr("timestampdiff(SECOND, valid_from, valid_to)")))


@register("latest_per_key", """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type,
  arg_max(value, (ts, event_id)) AS value, max(ts) AS updated_at FROM events GROUP BY user_id""")
def latest_per_key(spark, sf):
    ev = read_table(spark, sf, "events")
    return ch.latest_per_key(ev, "user_id", "ts", ["event_type", "value"], tie="event_id")


_HALVES = """t AS (SELECT user_id, count(*) AS events, round(sum(value), 6) AS total FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
s AS (SELECT user_id, count(*) AS events, round(sum(value), 6) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND user_id % 2 = 0 GROUP BY user_id)"""


@register("upsert_rows", f"""WITH {_HALVES}
SELECT coalesce(s.user_id, t.user_id) AS user_id,
       CASE WHEN s.user_id IS NOT NULL THEN s.events ELSE t.events END AS events,
       CASE WHEN s.user_id IS NOT NULL THEN s.total ELSE t.total END AS total,
       CASE WHEN s.user_id IS NULL THEN 'kept' WHEN t.user_id IS NULL THEN 'inserted' ELSE 'updated' END AS origin
FROM t FULL OUTER JOIN s ON s.user_id = t.user_id""")
def upsert_rows(spark, sf):
    """Per-user totals of the first half-month, merged with those of the second half
    for even users (the others are kept as they were)."""
    ev = read_table(spark, sf, "events")
    summ = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"),
                                                F.round(F.sum("value"), 6).alias("total"))
    target = summ(ev.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")))
    source = summ(ev.where((F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")) & (F.col("user_id") % 2 == 0)))
    return ch.upsert(target, source, "user_id", ["events", "total"])
