"""Mixing sources to target weights: hash-threshold histograms, in DataFrame functions only.

Every row has a hash that does not depend on where it lies. A source that is to give ``target`` words takes every row
``floor(target / size)`` times and, once more, the rows whose hash lies under a threshold: the thresholds of the
first, second and third copy are nested. The threshold is found without sorting: words are summed by source and
``BITS`` leading bits of the hash; the running sum over at most 2^BITS buckets of a source shows the one in which the budget
ends; only the rows of that bucket are kept and summed again by the next bits, until one row per source is left on the
edge. It is taken if that brings the sum nearer to the target, so a source misses its target by at
most half of one row. The whole table is then filtered by the thresholds.

A source with a third of all rows is pre-aggregated in the tasks that read it: a round shuffles at most 2^BITS rows per
source and task. Rounds grow with the logarithm of the largest source.

Targets: sources share the total by weight; one whose share exceeds ``repeat`` times its size gets that much, and
the rest is shared again among the others, until none exceeds it.

Defined results: a null text has size 0; rows of size 0 are never in the mix (``taken`` 0); a null source is a source of its
own, numbered last; rows equal in id, source and size are interchangeable, told apart by their place in the written table;
a null doc_id is hashed as an empty one; an empty table or one without words gives targets of 0; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import numbered, small_side, table

WEIGHTS = (5, 2, 1)
REPEAT = 3
SEED = "mix"
BITS = 12
DIGITS = 5               # 5 x 12 = 60 bits of a hash
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 100, repeat: int = REPEAT) -> DataFrame:
    """``sources`` (source, source_size) with ``sid`` (place in code-point order, null last), weight and ``target``.

    A share that is above its stop only rises while the rest is shared again, so the state of a round is two
    numbers: what is left to share, and the weight that shares it."""
    s = numbered(sources, [F.col("source").asc_nulls_last()], "sid")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")
    s = table(s.withColumn("weight", weight).withColumn("stop", (F.col("source_size") * repeat).cast("double")), "sources")
    first = s.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, left, w = float(first[0] or 0) * share / 100, float(first[0] or 0) * share / 100, first[1] or 1.0
    while True:
        above = F.lit(left) * F.col("weight") / F.lit(w) > F.col("stop")
        held, free = s.agg(F.sum(F.when(above, F.col("stop"))), F.sum(F.when(~above, F.col("weight")))).first()
        after = (budget - (held or 0.0), free or 1.0)
        if after == (left, w):
            return s.withColumn("target", F.when(above, F.col("stop")).otherwise(F.lit(left) * F.col("weight") / F.lit(w)))
        left, w = after


def _digit(level: int) -> Column:
    return F.shiftright(F.col("h1" if level < DIGITS else "h2"), BITS * (DIGITS - 1 - level % DIGITS)).bitwiseAND((1 << BITS) - 1)


def thresholds(rows: DataFrame) -> DataFrame:
    """Per source the hash under which a row is taken once more: sid, c1, c2, last (whether the row on the edge is, too).

    ``rows``: sid, size, h1 and h2 (hashes of 60 bits), ``left`` (what the source still has to give)."""
    edge = rows
    for level in range(2 * DIGITS):
        sums = edge.groupBy("sid", "left", _digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("words").over(Window.partitionBy("sid").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        found = (sums.withColumn("upto", upto).where("upto > left").groupBy("sid")
                 .agg(F.min(F.struct("digit", (F.col("upto") - F.col("words")).alias("before"), "n")).alias("f")).select("sid", "f.*"))
        found = table(found, "edges")
        inside = (F.col("sid") == F.col("e_sid")) & (_digit(level) == F.col("digit"))
        edge = edge.join(small_side(found.withColumnRenamed("sid", "e_sid"), 40), inside)
        edge = table(edge.select("sid", "size", "h1", "h2", (F.col("left") - F.col("before")).alias("left")), "edge")
        if found.where("n > 1").limit(1).count() == 0:
            break
    return edge.groupBy("sid").agg(F.min("h1").alias("c1"), F.min("h2").alias("c2"), (2 * F.max("left") >= F.sum("size")).alias("last"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 100, repeat: int = REPEAT, seed: str = SEED) -> DataFrame:
    """Every row of ``docs``: doc_id, source, size, source_size, target, copies (how often the mix has it), taken."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = table(docs.select("doc_id", "source", size.alias("size")), "sizes")
    share_of = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    share_of = table(share_of.select(F.col("source").alias("name"), "sid", "source_size", "target", copies.alias("base"),
                                     (F.col("target") - copies * F.col("source_size")).alias("left")), "targets")
    rows = sized.join(small_side(share_of, 300), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    rows = rows.withColumn("h1", F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long"))
    rows = table(rows.withColumn("h2", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)), "rows")
    cut = table(thresholds(rows.select("sid", "size", "h1", "h2", "left")), "cuts")
    under = ((F.col("h1") < F.col("c1")) | ((F.col("h1") == F.col("c1")) & ((F.col("h2") < F.col("c2"))
                                                                        | ((F.col("h2") == F.col("c2")) & F.col("last")))))
    times = F.col("base") + F.coalesce(under, F.lit(False)).cast("long")
    out = rows.join(small_side(cut, 48), "sid", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("copies"), (F.col("size") * times).alias("taken"))


ORACLE = r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
src AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS stop FROM sums),
lev(r, w) AS (SELECT sum(source_size)::DOUBLE, sum(weight) FROM src
  UNION SELECT (SELECT sum(source_size)::DOUBLE FROM src) - sum(CASE WHEN r * weight / w > stop THEN stop ELSE 0 END),
    sum(CASE WHEN r * weight / w > stop THEN 0 ELSE weight END) FROM lev, src GROUP BY r, w),
lv AS (SELECT r, w FROM lev ORDER BY w, r LIMIT 1),
tgt AS (SELECT source, source_size, least(r * weight / w, stop) AS target FROM src, lv),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM tgt),
cum AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.base, p.target - p.base * p.source_size AS budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY ('0x' || substr(sha256('mix:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.size), 1, 15))::BIGINT
      ROWS UNBOUNDED PRECEDING) AS upto FROM sized s JOIN plan p ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN upto <= budget OR (upto - size <= budget AND 2 * (budget - (upto - size)) >= size)
  THEN 1 ELSE 0 END))::BIGINT AS taken FROM cum
"""
