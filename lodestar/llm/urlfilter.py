"""URL filters: host-suffix and path-prefix expressions against a rule list.

Every distinct url is expanded into the expressions ``host suffix + path prefix`` that a rule could
have; expressions and rules meet in an equi-join on the first four bytes of their SHA-256, the whole
digests confirm, and the longest rule wins (at equal length the one that blocks). Prefix
lengths are those that occur among the rules: a path of any length gives as many expressions as there
are such lengths. All of it is built-in functions in the JVM.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule; no rule:
verdict ``allow``, rule null; a host ends at the first ``/ ? #`` (ports and users stay part of it);
repeated urls are judged once and every row keeps its own result; repeated equal rules count once, rules with
null parts are ignored; extra columns of the pages are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import small_side

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def with_parts(pages: DataFrame) -> DataFrame:
    """``host`` and ``path`` of each url."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    tail = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(tail, F.lit(""))})


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    r = rules.dropna(subset=["rule_host", "rule_path", "rule_verdict"]).dropDuplicates(["rule_host", "rule_path", "rule_verdict"])
    r = r.select(F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("digest"), (F.concat("rule_host", "rule_path")).alias("rule"),
                 "rule_verdict").withColumn("short", F.substring("digest", 1, 8))
    # as many numbers as rule paths have different lengths, whatever the number of rules
    cuts = sorted(x.cut for x in rules.select(F.length("rule_path").alias("cut")).where("cut is not null").distinct().collect())
    parts = with_parts(pages.select("page_id", "url"))
    urls = parts.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    expr = urls.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix"))
    lengths = F.array(*[F.lit(n) for n in cuts]).cast("array<int>")
    expr = expr.select("host", "path", "suffix", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("cut"))
    expr = expr.select("host", "path", F.sha2(F.concat_ws("\n", F.col("suffix"), F.expr("substring(path, 1, cut)")), 256).alias("digest"))
    met = (expr.withColumn("short", F.substring("digest", 1, 8)).join(small_side(r.withColumnRenamed("digest", "whole"), 400), "short")
           .where("digest = whole"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule_verdict").alias("verdict"),
                                                         F.col("rule"))).alias("best"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))


ORACLE = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS i, page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT i, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY i ORDER BY length(rule_host || rule_path) DESC,
  rule_verdict DESC) AS k FROM parts, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (i)
"""
